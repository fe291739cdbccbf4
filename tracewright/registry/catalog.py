"""All registered queries."""

from __future__ import annotations

from tracewright.registry import graph, hosts, imports, leads, reads, scans, streams  # noqa: F401
from tracewright.registry.base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
