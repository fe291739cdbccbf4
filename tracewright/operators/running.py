"""Running values over ordered rows, with no task that holds all rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

KINDS = {"max": F.max, "sum": F.sum}
PART = "_part"


def range_parts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of (by, order), written, with the number of the range; a hot key fills several ranges."""
    return cut_lineage(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


def running(parts: DataFrame, by: list[str], order: list[str], *, before: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """``parts`` of :func:`range_parts` with running values: name=(kind, column), kind ``max`` or ``sum``; nulls don't count.

    A value covers the rows of its key up to the row, or those ``before`` it; without any it is null. Rows
    that are alike in (by, order) are ordered anyhow. Every range works out its own running values; what earlier ranges of
    the key amount to, one row per range and key, is carried on.
    """
    names = {name: f"_carried_{name}" for name in values}
    totals = parts.groupBy(*by, PART).agg(*[KINDS[kind](column).alias(names[name]) for name, (kind, column) in values.items()])
    if by:
        earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*by, PART, *[KINDS[kind](names[name]).over(earlier).alias(names[name]) for name, (kind, _) in values.items()])
        same = reduce(lambda a, b: a & b, [parts[c].eqNullSafe(carried[c]) for c in by], parts[PART] == carried[PART])
        joined = parts.join(carried, same).select(parts["*"], *[carried[n] for n in names.values()])
    else:
        rows, sofar, out = sorted(totals.collect(), key=lambda r: r[PART]), dict.fromkeys(names), []
        for row in rows:  # one row per range
            out.append((row[PART], *sofar.values()))
            for name, (kind, _) in values.items():
                both = [v for v in (sofar[name], row[names[name]]) if v is not None]
                sofar[name] = (max if kind == "max" else sum)(both) if both else None
        schema = ", ".join([f"{PART} int", *(f"{n} {dict(totals.dtypes)[n]}" for n in names.values())])
        joined = parts.join(parts.sparkSession.createDataFrame(out, schema), PART)
    frame = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    here = {name: KINDS[kind](column).over(frame) for name, (kind, column) in values.items()}
    for name, (kind, _) in values.items():
        zero = F.coalesce(here[name], F.lit(0)) + F.coalesce(names[name], F.lit(0))
        either = F.coalesce(here[name], F.col(names[name])).isNotNull()
        joined = joined.withColumn(name, F.greatest(here[name], F.col(names[name])) if kind == "max" else F.when(either, zero))
    return joined.drop(*names.values())
