"""Effort routing of findings and status changes from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import lookup

# Points, thresholds, routes and reasons.
SEVERITY_POINTS = {
    "CRITICAL": 120, "HIGH": 90, "MEDIUM": 50, "UNASSESSED": 20, "LOW": 10, "INFO": 0, "UNKNOWN": 0,
}
ROUTE_ORDER = {"DEEP_8B": 1, "FAST_4B": 2, "STORE_ONLY": 3}
REASON_SEVERITY = "Higher-severity evidence requires deeper review"
REASON_FAMILIES = "Multiple independent evidence families"
REASON_SIZE = "Larger supporting evidence set"
REASON_NONE = "No higher-effort generic routing criteria met"


def route_columns() -> dict[str, Column]:
    """Route, score and reasons from severity, family count and evidence count."""
    severity = F.upper(F.coalesce(F.nullif("severity", F.lit("")), F.lit("UNKNOWN")))
    families = F.coalesce(F.col("independent_family_count"), F.lit(0))
    size = F.coalesce(F.col("evidence_count"), F.lit(0))
    high = severity.isin("CRITICAL", "HIGH")
    score = (
        lookup(SEVERITY_POINTS, severity, 0)
        + F.when(families >= 2, 25).otherwise(0)
        + F.when(size >= 10, 5).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(high, REASON_SEVERITY),
            F.when(families >= 2, REASON_FAMILIES),
            F.when(size >= 10, REASON_SIZE),
        )
    )
    return {
        "routing_score": score.cast("long"),
        "planned_route": F.when(high, "DEEP_8B")
        .when((families >= 2) | (severity == "MEDIUM"), "FAST_4B")
        .otherwise("STORE_ONLY"),
        "reasons": F.when(F.size(reasons) == 0, F.array(F.lit(REASON_NONE))).otherwise(reasons),
    }


def route_findings(findings: DataFrame, analysed: DataFrame, run_id: str) -> DataFrame:
    """Routes of a run; findings that already have a deep result are ANALYZED_8B."""
    done = analysed.select("finding_id").distinct().withColumn("_done", F.lit(True))
    columns = route_columns()
    return (
        findings.join(done, "finding_id", "left")
        .select(
            F.lit(run_id).alias("run_id"),
            "finding_id", "finding_type", "severity", "confidence", "title",
            "independent_family_count", "evidence_count",
            *[column.alias(name) for name, column in columns.items()],
            F.when(F.col("_done"), "ANALYZED_8B").otherwise("PENDING").alias("status"),
            "start_timestamp", "end_timestamp",
        )
    )


def write_routes(routes: DataFrame, path: str) -> None:
    """Replace the rows of the run, leave other runs alone."""
    (
        routes.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def apply_results(routes: DataFrame, fast: DataFrame, deep: DataFrame) -> DataFrame:
    """New status per route from model results (one row per finding on each side).

    A deep result closes the finding. A fast result on a fast route completes
    it or escalates it.
    """
    # Any fast result that escalates decides.
    quick = fast.groupBy("finding_id").agg(F.max("escalate").alias("_escalate"))
    slow = deep.select("finding_id").distinct().withColumn("_deep", F.lit(True))
    status = (
        F.when(F.col("_deep"), "ANALYZED_8B")
        .when(
            (F.col("planned_route") == "FAST_4B") & F.col("_escalate").isNotNull(),
            F.when(F.col("_escalate"), "ESCALATE_8B").otherwise("FAST_4B_COMPLETE"),
        )
        .otherwise(F.col("status"))
    )
    return (
        routes.join(quick, "finding_id", "left")
        .join(slow, "finding_id", "left")
        .withColumn("status", status)
        .drop("_escalate", "_deep")
    )


def deep_selection(routes: DataFrame, analysed: DataFrame) -> DataFrame:
    """Findings that still need deep work."""
    wanted = (F.col("status") == "ESCALATE_8B") | (
        (F.col("planned_route") == "DEEP_8B") & (F.col("status") == "PENDING")
    )
    return routes.filter(wanted).join(analysed.select("finding_id").distinct(), "finding_id", "left_anti")


def deep_inputs(routes: DataFrame, analysed: DataFrame, packages: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected findings with package and optional references, findings without a package).

    ``references`` holds one or more rows per finding with a ``source_path``;
    the first path in order is used.
    """
    selected = deep_selection(routes, analysed)
    first = references.groupBy("finding_id").agg(F.min_by("references", "source_path").alias("references"))
    ready = selected.join(packages, "finding_id").join(first, "finding_id", "left")
    return ready, selected.join(packages, "finding_id", "left_anti").select("finding_id")


def route_counts(routes: DataFrame) -> DataFrame:
    """Counts by route and status."""
    return routes.groupBy("planned_route", "status").agg(F.count(F.lit(1)).alias("n"))


def top_pending(routes: DataFrame, n: int = 20) -> DataFrame:
    """Pending routes in work order."""
    return (
        routes.filter(F.col("status") == "PENDING")
        .orderBy(
            lookup(ROUTE_ORDER, F.col("planned_route"), 9),
            F.desc("routing_score"), F.desc("evidence_count"), "finding_id",
        )
        .limit(n)
    )
