"""Gap sessions without a per-key sort of the raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.running import PART, range_parts, running
from tracewright.session import cut_lineage


def session_cells(df: DataFrame, keys: list[str], ts_us: str, gap_us: int) -> DataFrame:
    """(keys, _cell, session_no, first_us, last_us, n) per occupied time cell.

    Rows of one key inside a cell as wide as the gap are never further apart
    than the gap, so they share a session. Grouping to cells combines before
    the shuffle; the windows then see one row per occupied cell, a number that
    time bounds and row counts do not. Without keys the cells are worked on in ranges.
    """
    cells = df.groupBy(*keys, F.floor(F.col(ts_us) / F.lit(gap_us)).alias("_cell")).agg(
        F.min(ts_us).alias("first_us"),
        F.max(ts_us).alias("last_us"),
        F.count(F.lit(1)).alias("n"),
    )
    if not keys:  # one sequence of all rows: in ranges of time
        parts = range_parts(cells, [], ["_cell"])
        seen = running(parts, [], ["_cell"], before=True, _previous=("max", F.col("last_us")))
        begins = F.when(F.col("first_us") - F.col("_previous") <= gap_us, 0).otherwise(1)
        marked = cut_lineage(seen.withColumn("_starts", begins))
        return running(marked, [], ["_cell"], session_no=("sum", F.col("_starts"))).drop("_starts", "_previous", PART)
    order = Window.partitionBy(*keys).orderBy("_cell")
    previous = F.lag("last_us").over(order)
    starts = F.when(
        previous.isNotNull() & (F.col("first_us") - previous <= gap_us), 0
    ).otherwise(1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.withColumn("_starts", starts)
        .withColumn("session_no", F.sum("_starts").over(so_far))
        .drop("_starts")
    )


def sessionize(df: DataFrame, keys: list[str], ts_us: str, gap_us: int) -> DataFrame:
    """One row per session: (keys, session_no, first_us, last_us, n).

    A gap of exactly ``gap_us`` stays in the session.
    """
    return (
        session_cells(df, keys, ts_us, gap_us)
        .groupBy(*keys, "session_no")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("n").alias("n"),
        )
    )


def assign_sessions(df: DataFrame, keys: list[str], ts_us: str, gap_us: int) -> DataFrame:
    """Every row with its ``session_no``."""
    cells = session_cells(df, keys, ts_us, gap_us).select(*keys, "_cell", "session_no")
    located = df.withColumn("_cell", F.floor(F.col(ts_us) / F.lit(gap_us)))
    return located.join(cells, [*keys, "_cell"]).drop("_cell")
