"""Evidence analytics on Spark: every operator is DataFrame in, DataFrame out."""

from tracewright.session import build_session

__all__ = ["build_session"]
