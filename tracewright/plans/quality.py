"""Integrity checks as small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed result values.
ASSESSMENTS = ["LIKELY_BENIGN", "NEEDS_REVIEW", "SUSPICIOUS", "HIGH_PRIORITY_REVIEW", "INSUFFICIENT_EVIDENCE"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]


class IntegrityError(RuntimeError):
    """A check found rows."""


def _line(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("bad_rows")).select(F.lit(name).alias("check"), "bad_rows")


def duplicate_uids(events: DataFrame) -> DataFrame:
    """Uids that occur more than once."""
    return events.groupBy("event_uid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing_references(references: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct referenced uids without an event."""
    return references.select("event_uid").distinct().join(events.select("event_uid"), "event_uid", "left_anti")


def event_checks(events: DataFrame) -> DataFrame:
    """Duplicate keys, missing provenance and blank required text."""
    return (
        _line("duplicate_uid", duplicate_uids(events))
        .unionByName(_line("missing_provenance", events.filter(F.col("provenance").isNull())))
        .unionByName(_line("unreadable_time", events.filter(F.col("event_ts").isNull())))
    )


def edge_checks(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Self edges, repeated edges and ends without an event."""
    ends = edges.select(F.explode(F.array("event_uid_a", "event_uid_b")).alias("event_uid"))
    return (
        _line("self_edge", edges.filter(F.col("event_uid_a") == F.col("event_uid_b")))
        .unionByName(_line("duplicate_edge", edges.groupBy("edge_uid").count().filter("count > 1")))
        .unionByName(_line("missing_event", missing_references(ends, events)))
    )


def require_clean(checks: DataFrame) -> None:
    """Raise when any check found rows; the table has one row per check."""
    broken = {r["check"]: r["bad_rows"] for r in checks.filter(F.col("bad_rows") > 0).collect()}
    if broken:
        raise IntegrityError(str(broken))


def source_changed(ledger: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Imports whose source has another hash or size now, or is gone."""
    now = fingerprints.select(
        F.col("path").alias("parser_output"), F.col("sha256").alias("_sha"), F.col("length").alias("_size")
    )
    return ledger.join(now, "parser_output", "left").filter(
        F.col("_sha").isNull() | (F.col("_sha") != F.col("source_sha256")) | (F.col("_size") != F.col("source_size"))
    ).select("import_id", "parser_output")


def _violation(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)), F.lit(name))


def result_problems(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Results with their problems: bad enum values, a suspicious result that
    does not escalate, or cited uids outside the finding's evidence.

    Cited uids are checked by an anti join on (finding, uid), so evidence of a
    finding is never gathered into a list.
    """
    cited = results.select("finding_id", F.explode(F.array_distinct("supporting_event_uids")).alias("event_uid"))
    known = evidence.select("finding_id", "event_uid").distinct()
    unknown = (
        cited.join(known, ["finding_id", "event_uid"], "left_anti")
        .groupBy("finding_id")
        .agg(F.count(F.lit(1)).alias("_unknown"))
    )
    problems = F.array_compact(
        F.array(
            _violation(~F.col("assessment").isin(ASSESSMENTS), "assessment"),
            _violation(~F.col("priority").isin(PRIORITIES), "priority"),
            _violation(~F.col("confidence").isin(CONFIDENCES), "confidence"),
            _violation((F.col("assessment") == "SUSPICIOUS") & ~F.col("escalate"), "escalation"),
            F.when(F.col("_unknown") > 0, F.lit("unknown_uid")),
        )
    )
    return (
        results.join(unknown, "finding_id", "left")
        .select("finding_id", problems.alias("problems"))
        .filter(F.size("problems") > 0)
    )


def fact_problems(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts of results that cite nothing or something unknown.

    ``facts`` is (finding_id, fact_no, event_uids).
    """
    empty = facts.filter(F.size(F.coalesce("event_uids", F.array().cast("array<string>"))) == 0).select(
        "finding_id", "fact_no", F.lit("no_uid").alias("problem")
    )
    cited = facts.select("finding_id", "fact_no", F.explode("event_uids").alias("event_uid"))
    unknown = (
        cited.join(evidence.select("finding_id", "event_uid"), ["finding_id", "event_uid"], "left_anti")
        .select("finding_id", "fact_no", F.lit("unknown_uid").alias("problem"))
        .distinct()
    )
    return empty.unionByName(unknown)


def uids_of_indexes(indexes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence indexes of results to uids: (finding_id, position, event_uid).

    ``indexes`` is (finding_id, evidence_indexes); ``evidence`` carries its
    0-based position. An index without evidence gives a NULL uid.
    """
    wanted = indexes.select("finding_id", F.explode(F.array_distinct("evidence_indexes")).alias("position"))
    return wanted.join(evidence.select("finding_id", "position", "event_uid"), ["finding_id", "position"], "left")
