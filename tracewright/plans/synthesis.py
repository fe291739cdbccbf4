"""Case synthesis from findings and their model results.

Inputs are tables: findings (header), finding uids (finding_id, seq, event_uid)
and results per finding. Lists without a size bound stay tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import lookup
from tracewright.functions.payload import (
    clean_recommendation,
    finding_theme,
    normalize_statement,
    recommendation_key,
)
from tracewright.functions.text import clean, short
from tracewright.functions.times import format_ts, micros
from tracewright.operators.sessions import assign_sessions
from tracewright.operators.skew import first_by, salted_join, top_n

# Ranks, sources, caps.
ASSESSMENT_RANKS = {
    "HIGH_PRIORITY_REVIEW": 5, "SUSPICIOUS": 4, "NEEDS_REVIEW": 3, "INSUFFICIENT_EVIDENCE": 2, "LIKELY_BENIGN": 1,
}
PRIORITY_RANKS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
DEEP, FAST, NONE = "QWEN3_8B_DEEP", "QWEN3_4B_FAST", "NONE"
SUMMARY_FACT_TYPES = ["POWERSHELL_HISTORY_LEAD", "CORE_CROSS_ARTIFACT_LEAD", "CROSS_ARTIFACT_ACTIVITY_LEAD"]
TEXT_CAP = 12
SESSION_GAP_SECONDS = 900
SESSION_TITLES = 6
SESSION_CAP = 12
THEME_TITLES = 3
# List caps of results and references, text caps.
DEEP_LIST_CAPS = {
    "observed_facts": 6, "analytical_assessment": 4, "alternative_explanations": 3, "evidence_gaps": 5,
    "recommended_next_steps": 5,
}
FAST_UID_CAP = 3
REFERENCE_CAP = 4
SUMMARY_CHARS = 900
REASON_CHARS = 300


def compact_deep(results: DataFrame) -> DataFrame:
    """Deep results with capped lists and summary."""
    out = results.withColumn("executive_summary", short("executive_summary", SUMMARY_CHARS))
    for name, cap in DEEP_LIST_CAPS.items():
        if name in results.columns:
            out = out.withColumn(name, F.slice(name, 1, cap))
    return out


def compact_fast(results: DataFrame) -> DataFrame:
    """Fast results with a capped reason and uid list."""
    return results.withColumn("reason", short("reason", REASON_CHARS)).withColumn(
        "supporting_event_uids", F.slice("supporting_event_uids", 1, FAST_UID_CAP)
    )


def results_by_precedence(findings: DataFrame, deep: DataFrame, fast: DataFrame, references: DataFrame) -> DataFrame:
    """Each finding with its deep result, else its fast one, else none, and the
    number of kept historical references."""
    fields = ["assessment", "priority", "confidence"]

    def side(results: DataFrame, prefix: str) -> DataFrame:
        # Of several results of a finding the first in field order counts.
        one = first_by(results.select("finding_id", *fields), ["finding_id"], fields)
        return one.select("finding_id", F.lit(True).alias(f"{prefix}_hit"), *[F.col(c).alias(f"{prefix}_{c}") for c in fields])

    counted = references.groupBy("finding_id").agg(
        F.least(F.count(F.lit(1)), F.lit(REFERENCE_CAP)).alias("historical_reference_count")
    )
    joined = (
        findings.join(side(deep, "deep"), "finding_id", "left")
        .join(side(fast, "fast"), "finding_id", "left")
        .join(counted, "finding_id", "left")
    )
    source = F.when(F.col("deep_hit"), DEEP).when(F.col("fast_hit"), FAST).otherwise(NONE)
    picked = {c: F.when(F.col("deep_hit"), F.col(f"deep_{c}")).otherwise(F.col(f"fast_{c}")) for c in fields}

    def given(value, *fallbacks):
        return F.coalesce(F.nullif(value, F.lit("")), *fallbacks)

    return joined.select(
        *findings.columns,
        source.alias("ai_source"),
        given(picked["assessment"], F.lit("INSUFFICIENT_EVIDENCE")).alias("assessment"),
        given(picked["priority"], F.nullif("severity", F.lit("")), F.lit("MEDIUM")).alias("ai_priority"),
        given(picked["confidence"], F.nullif("confidence", F.lit("")), F.lit("LOW")).alias("ai_confidence"),
        F.coalesce("historical_reference_count", F.lit(0)).alias("historical_reference_count"),
    )


def ranked_findings(resolved: DataFrame, uid_counts: DataFrame) -> DataFrame:
    """Key findings with rank columns; order by them for presentation."""
    return resolved.join(uid_counts, "finding_id", "left").select(
        "finding_id", "title", "finding_type", "severity", "assessment", "ai_priority", "ai_confidence", "ai_source",
        F.coalesce("uid_count", F.lit(0)).alias("uid_count"),
        "historical_reference_count",
        lookup(ASSESSMENT_RANKS, F.col("assessment"), 0).alias("assessment_rank"),
        lookup(PRIORITY_RANKS, F.col("ai_priority"), 0).alias("priority_rank"),
    )


def key_finding_order():
    """Presentation order of key findings."""
    return [F.desc("assessment_rank"), F.desc("priority_rank"), F.desc("uid_count"), F.asc("finding_id")]


def overall(resolved: DataFrame) -> DataFrame:
    """One row: highest assessment and priority, confidence and result counts.

    Equal ranks resolve to the value that sorts first.
    """
    a_rank = lookup(ASSESSMENT_RANKS, F.col("assessment"), 0)
    p_rank = lookup(PRIORITY_RANKS, F.col("ai_priority"), 0)
    return resolved.agg(
        F.min_by("assessment", F.struct(-a_rank, "assessment")).alias("a"),
        F.min_by("ai_priority", F.struct(-p_rank, "ai_priority")).alias("p"),
        F.count_if(F.col("ai_source") == DEEP).alias("deep_count"),
        F.count_if(F.col("ai_source") == FAST).alias("fast_count"),
        F.count_if(F.col("ai_source") == NONE).alias("none_count"),
        F.count(F.lit(1)).alias("finding_count"),
    ).select(
        F.coalesce("a", F.lit("INSUFFICIENT_EVIDENCE")).alias("overall_assessment"),
        F.coalesce("p", F.lit("LOW")).alias("overall_priority"),
        F.when(F.col("deep_count") > 0, "HIGH").otherwise("MEDIUM").alias("overall_confidence"),
        "deep_count", "fast_count", "none_count", "finding_count",
    )


def value_counts(resolved: DataFrame) -> DataFrame:
    """Counts per assessment and per priority as (metric, label, n)."""
    labels = F.array(
        F.struct(F.lit("assessment").alias("metric"), F.col("assessment").alias("label")),
        F.struct(F.lit("priority").alias("metric"), F.col("ai_priority").alias("label")),
    )
    return (
        resolved.select(F.explode(labels).alias("x"))
        .groupBy("x.metric", "x.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def theme_summary(findings: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(themes with counts and first titles, distinct (theme, event_uid) links).

    ``findings`` carries finding_id, title and seq (presentation order).
    """
    themed = findings.select("finding_id", "seq", "title", finding_theme(F.col("title")).alias("theme"))
    firsts = (
        themed.filter(clean("title") != "")
        .groupBy("theme", "title")
        .agg(F.min("seq").alias("seq"))
    )
    titles = (
        top_n(firsts, ["theme"], [F.asc("seq"), F.asc("title")], THEME_TITLES)
        .groupBy("theme")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("t"))
        .select("theme", F.col("t.title").alias("representative_findings"))
    )
    links = (
        salted_join(
            uids.filter(clean("event_uid") != "").select("finding_id", "event_uid"),
            themed.select("finding_id", "theme"), ["finding_id"], salt_by=["event_uid"],
        )
        .select("theme", "event_uid")
        .distinct()
    )
    counts = themed.groupBy("theme").agg(F.count(F.lit(1)).alias("finding_count"))
    uid_counts = links.groupBy("theme").agg(F.count(F.lit(1)).alias("uid_count"))
    themes = (
        counts.join(uid_counts, "theme", "left")
        .join(titles, "theme", "left")
        .withColumn("uid_count", F.coalesce("uid_count", F.lit(0)))
    )
    return themes, links


def merge_facts(facts: DataFrame, fact_uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct fact, distinct (fact_key, event_uid) links).

    ``facts`` is (fact_id, seq, fact, source); ``fact_uids`` is (fact_id, event_uid).
    The first spelling and source win. A fact shared by a huge group of copies
    is one aggregate row; its uids stay a table.
    """
    keyed = facts.select(
        "fact_id", "seq", clean("fact").alias("fact"), "source", normalize_statement(F.col("fact")).alias("fact_key")
    ).filter(F.col("fact_key") != "")
    merged = keyed.groupBy("fact_key").agg(
        F.min_by(F.struct("fact", "source"), F.struct("seq", "fact_id")).alias("first"),
        F.count(F.lit(1)).alias("statements"),
    )
    links = (
        salted_join(
            fact_uids.filter(clean("event_uid") != "").select("fact_id", "event_uid"),
            keyed.select("fact_id", "fact_key"), ["fact_id"], salt_by=["event_uid"],
        )
        .select("fact_key", "event_uid")
        .distinct()
    )
    counts = links.groupBy("fact_key").agg(F.count(F.lit(1)).alias("uid_count"))
    rows = merged.join(counts, "fact_key", "left").select(
        "fact_key", F.col("first.fact").alias("fact"), F.col("first.source").alias("source"), "statements",
        F.coalesce("uid_count", F.lit(0)).alias("uid_count"),
    )
    return rows, links


def summary_facts(findings: DataFrame, uids: DataFrame) -> DataFrame:
    """Deterministic findings whose summary counts as a grounded fact."""
    return findings.filter(
        F.col("finding_type").isin(SUMMARY_FACT_TYPES) & (clean("summary") != "")
    ).join(uids.select("finding_id").distinct(), "finding_id", "left_semi")


def distinct_texts(texts: DataFrame, *, cap: int | None = None) -> DataFrame:
    """First spelling of each text ignoring case; ``texts`` is (seq, text)."""
    rows = (
        texts.select("seq", clean("text").alias("text"))
        .filter(F.col("text") != "")
        .groupBy(F.lower("text").alias("text_key"))
        .agg(F.min_by(F.struct("seq", "text"), F.struct("seq", "text")).alias("first"))
        .select("first.seq", "first.text")
    )
    return rows.orderBy("seq", "text").limit(cap) if cap else rows


def distinct_recommendations(texts: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Cleaned recommendations, one per action; ``texts`` is (seq, text)."""
    rows = (
        texts.select("seq", clean_recommendation(F.col("text")).alias("text"))
        .filter(F.col("text") != "")
        .withColumn("action_key", recommendation_key(F.col("text")))
        .filter(F.col("action_key") != "")
        .groupBy("action_key")
        .agg(F.min_by(F.struct("seq", "text"), F.struct("seq", "text")).alias("first"))
        .select("first.seq", "first.text")
    )
    return rows.orderBy("seq", "text").limit(cap) if cap else rows


def grounded_timeline(findings: DataFrame, uids: DataFrame, events: DataFrame) -> DataFrame:
    """One row per finding at its earliest event, repeats of (time, title) dropped.

    ``findings`` carries seq. Log events win ties; the earliest event is a
    mergeable minimum, so a finding with very many events is no bottleneck.
    """
    facts = events.filter(F.col("event_ts").isNotNull()).select(
        "event_uid", "event_ts", "timestamp", "timestamp_type", "timestamp_source", "hostname", "windows_event_id",
        "provider", "source_tool",
    )
    rows = uids.select("finding_id", "event_uid").join(facts, "event_uid")
    log_first = F.when(F.col("source_tool") == "evtxecmd", 0).otherwise(1)
    earliest = first_by(rows, ["finding_id"], ["event_ts", log_first.alias("_log"), "event_uid"])
    placed = findings.select("finding_id", "seq", "title").join(earliest, "finding_id")
    keyed = placed.withColumn("title_key", normalize_statement(F.col("title"))).withColumn(
        "theme", finding_theme(F.col("title"))
    )
    return first_by(keyed, ["event_ts", "title_key"], ["seq", "finding_id"])


def related_activity(
    timeline: DataFrame, *, gap_seconds: int = SESSION_GAP_SECONDS, cap: int | None = SESSION_CAP
) -> DataFrame:
    """Sessions of at least two rows and two distinct titles.

    Titles are the first six by time. Event links of a session are found by
    joining the timeline on the session bounds' number.
    """
    rows = timeline.select(
        "finding_id", "title", "theme", "hostname", "event_uid", "event_ts",
        micros(F.col("event_ts")).alias("us"),
    )
    located = assign_sessions(rows, [], "us", gap_seconds * 1_000_000)
    sessions = located.groupBy("session_no").agg(
        F.min("event_ts").alias("start_ts"),
        F.max("event_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("finding_count"),
        F.array_sort(F.collect_set("theme")).alias("themes"),
    )
    firsts = (
        located.filter(clean("title") != "")
        .groupBy("session_no", "title")
        .agg(F.min(F.struct("us", "finding_id")).alias("at"))
    )
    title_counts = firsts.groupBy("session_no").agg(F.count(F.lit(1)).alias("title_count"))
    titles = (
        top_n(firsts, ["session_no"], [F.asc("at"), F.asc("title")], SESSION_TITLES)
        .groupBy("session_no")
        .agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("t"))
        .select("session_no", F.col("t.title").alias("titles"))
    )
    kept = (
        sessions.filter(F.col("finding_count") >= 2)
        .join(title_counts.filter(F.col("title_count") >= 2), "session_no")
        .join(titles, "session_no")
        .select(
            "session_no", format_ts(F.col("start_ts")).alias("start_time"),
            format_ts(F.col("end_ts")).alias("end_time"), "finding_count", "title_count", "themes", "titles",
        )
    )
    return kept.orderBy("start_time", "session_no").limit(cap) if cap else kept


def grounding_statistics(resolved: DataFrame, uids: DataFrame) -> DataFrame:
    """Distinct grounded uids and findings per result source, as (metric, n)."""
    grounded = uids.filter(clean("event_uid") != "").agg(F.count_distinct("event_uid").alias("n"))
    counts = resolved.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("ai_source") == DEEP).alias("deep"),
        F.count_if(F.col("ai_source") == FAST).alias("fast"),
        F.count_if(F.col("ai_source") == NONE).alias("none"),
        F.count_if(F.col("historical_reference_count") > 0).alias("with_references"),
    )
    names = ["findings", "deep", "fast", "none", "with_references"]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names])
    return counts.select(F.explode(rows).alias("x")).select("x.metric", "x.n").unionByName(
        grounded.select(F.lit("unique_event_uids").alias("metric"), "n")
    )
