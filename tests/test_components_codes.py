"""Components of text nodes: rounds over hashes, whatever the hashes do."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import union_find

from tracewright.operators import components

EDGES = [(f"v{a:02}", f"v{b:02}") for a, b in (random.Random(9).sample(range(70), 2) for _ in range(60))] + [("z", "z")]


def components_of(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    rows = components.connected_components(df, "a", "b").collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_rounds_move_no_texts(spark, monkeypatch):
    kinds = []
    contract = components._contract if hasattr(components, "_contract") else None
    assert contract, "rounds run over the texts"
    monkeypatch.setattr(components, "_contract", lambda pairs, rounds: kinds.append(dict(pairs.dtypes)) or contract(pairs, rounds))
    assert components_of(spark, EDGES) == union_find(EDGES)
    assert kinds == [{"node": "bigint", "peer": "bigint"}]


@pytest.mark.parametrize("good", [1, None])
def test_hashes_that_meet(spark, monkeypatch, good):
    """Two nodes of one hash are not one node: another seed is taken, or the texts."""
    code = components._code
    narrow = lambda name, seed: code(name, seed) if seed == good else F.length(name).cast("long")
    monkeypatch.setattr(components, "_code", narrow)
    assert components_of(spark, EDGES) == union_find(EDGES)


def test_missing_ends_take_no_part(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None), (None, "b"), (None, None)], "a string, b string")
    rows = components.connected_components(df, "a", "b").collect()
    assert {(r["node"], r["component"]) for r in rows} == {("a", "a"), ("b", "a")} and len(rows) == 2
