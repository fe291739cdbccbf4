"""Interval join on shared keys, and counts over closed time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.running import PART, range_parts, running
from tracewright.operators.skew import salted_join
from tracewright.session import cut_lineage


def interval_join(
    anchors: DataFrame,
    candidates: DataFrame,
    keys: list[str],
    *,
    anchor_us: str,
    candidate_us: str,
    window_us: int,
    salt_by: list[str],
    hot_on: list[str] | None = None,
) -> DataFrame:
    """Pairs with equal ``keys`` and |anchor - candidate| <= ``window_us``.

    A candidate sits in one time bucket as wide as the window, an anchor looks
    at its own bucket and both neighbours, so each pair appears once and the
    join is a plain equi-join. Hot cells are salted; ``hot_on`` names the part
    of ``keys`` to count them by.
    """
    width = F.lit(window_us)
    cell = F.floor(F.col(candidate_us) / width)
    right = candidates.withColumn("_cell", cell)
    around = F.floor(F.col(anchor_us) / width)
    left = anchors.withColumn("_cell", F.explode(F.sequence(around - 1, around + 1)))
    joined = salted_join(
        right, left, [*keys, "_cell"], salt_by=salt_by, hot_on=[*(hot_on or keys), "_cell"]
    )
    return joined.drop("_cell").filter(
        F.abs(F.col(anchor_us) - F.col(candidate_us)) <= window_us
    )


def crowded_anchors(
    anchors: DataFrame,
    events: DataFrame,
    *,
    uid: str,
    group: str,
    source: str,
    ts_us: str,
    window_us: int,
    limit: int,
) -> DataFrame:
    """Anchors with more than ``limit`` events of other sources in their window.

    ``anchors`` and ``events`` both carry ``group``, ``source`` and ``ts_us``.
    Counts per window-wide cell come first (combined before the shuffle) and
    are written out; mostly no cell is crowded and that ends it. Only cells whose neighbourhood can exceed the limit go on to the exact count,
    which works on one row per distinct microsecond: a cell holds at most
    ``window_us`` of those per source however many events there are.
    """
    width = F.lit(window_us)
    cell = F.floor(F.col(ts_us) / width)
    coarse = cut_lineage(
        events.groupBy(group, cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"), "_n")
        .groupBy(group, "_cell")
        .agg(F.sum("_n").alias("_n"))
        .filter(F.col("_n") > limit)
        .select(group, "_cell")
    )
    if coarse.isEmpty():
        return anchors.select(uid).limit(0)
    suspects = anchors.withColumn("_cell", cell).join(coarse, [group, "_cell"], "left_semi")

    # Running counts within a cell, at each distinct microsecond and at both
    # edges of each suspect window. Rank 1 rows add, rank 0 and 2 only read.
    near = coarse.select(
        group, F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell")
    ).distinct()
    points = (
        events.withColumn("_cell", cell)
        .join(near, [group, "_cell"], "left_semi")
        .groupBy(group, "_cell", source, ts_us)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    probes = suspects.select(group, source, ts_us).distinct()
    edges = probes.select(
        group,
        source,
        F.col(ts_us).alias("_anchor"),
        F.explode(
            F.array(
                F.struct((F.col(ts_us) - window_us).alias("at"), F.lit(0).alias("rank")),
                F.struct((F.col(ts_us) + window_us).alias("at"), F.lit(2).alias("rank")),
            )
        ).alias("_edge"),
    ).select(
        group,
        F.floor(F.col("_edge.at") / width).alias("_cell"),
        source,
        F.col("_edge.at").alias(ts_us),
        F.lit(0).cast("long").alias("_n"),
        F.col("_edge.rank").alias("_rank"),
        "_anchor",
    )
    rows = points.select(
        group, "_cell", source, ts_us, "_n",
        F.lit(1).alias("_rank"), F.lit(None).cast("long").alias("_anchor"),
    ).unionByName(edges)
    # Both running counts are worked out over ranges of time, so a cell may hold any number of points.
    order = [ts_us, "_rank"]
    all_sources = running(range_parts(rows, [group, "_cell"], order), [group, "_cell"], order, _seen_all=("sum", F.col("_n"))).drop(PART)
    own = [group, "_cell", source]
    own_source = running(range_parts(all_sources, own, order), own, order, _seen_own=("sum", F.col("_n"))).drop(PART)
    seen = own_source.withColumn("_seen", F.col("_seen_all") - F.col("_seen_own")).filter(F.col("_anchor").isNotNull())
    # events in the window = rest of the lower cell + whole middle cell + head of the upper cell
    cell_totals = (
        points.groupBy(group, "_cell")
        .agg(F.sum("_n").alias("_all"))
    )
    own_totals = points.groupBy(group, "_cell", source).agg(F.sum("_n").alias("_own"))
    per_anchor = (
        seen.groupBy(group, source, "_anchor")
        .agg(
            F.max(F.when(F.col("_rank") == 0, F.col("_seen"))).alias("_before"),
            F.max(F.when(F.col("_rank") == 2, F.col("_seen"))).alias("_upto"),
        )
        .withColumn("_mid", F.floor(F.col("_anchor") / width))
    )
    whole = (
        per_anchor.withColumn("_cell", F.explode(F.array(F.col("_mid") - 1, F.col("_mid"))))
        .join(cell_totals, [group, "_cell"], "left")
        .join(own_totals, [group, "_cell", source], "left")
        .groupBy(group, source, "_anchor")
        .agg(
            F.first("_before").alias("_before"),
            F.first("_upto").alias("_upto"),
            F.sum(F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("_whole"),
        )
    )
    crowded = whole.filter(
        F.col("_whole") - F.col("_before") + F.col("_upto") > limit
    ).select(group, source, F.col("_anchor").alias(ts_us))
    return suspects.join(crowded, [group, source, ts_us], "left_semi").select(uid)
