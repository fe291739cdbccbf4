"""Global numbering and budgeted prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 1..n in a total order without one task seeing them all.

    Rows are range-sorted and written with a per-partition id; partition sizes
    give the offsets. The offset table has one row per partition, so its size
    bound is the shuffle partition count and it is broadcast.
    """
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    written = cut_lineage(ordered)
    part = F.shiftright("_id", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_id") - F.shiftleft("_part", 33)
    return (
        written.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_id", "_part", "_offset")
    )


def budget_prefix(
    df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int, *, min_cost: int = 1
) -> DataFrame:
    """Leading rows of each group while their running cost stays in budget.

    The first row is always kept. Every row must cost at least ``min_cost``, so
    at most ``budget / min_cost + 1`` rows of a group can be kept; that rank limit
    runs before the shuffle and makes the running sum safe for a hot group.
    """
    rank = Window.partitionBy(*by).orderBy(*order)
    running = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = budget // min_cost + 1
    return (
        df.withColumn("_cost", cost)
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= limit)
        .withColumn("running_cost", F.sum("_cost").over(running))
        .filter((F.col("running_cost") <= budget) | (F.col("_rank") == 1))
        .drop("_cost", "_rank")
    )
