"""Report tables: counts, diversified evidence, assessment distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import first_match, lookup
from tracewright.functions.payload import (
    PERSISTENCE_LABELS,
    parse_event_payload,
    persistence_observation,
    without_blanks,
)
from tracewright.functions.text import clean, collapse, first_nonempty, nonblank
from tracewright.operators.skew import top_n
from tracewright.plans.lookups import activity_display, specific_path, trusted_time
from tracewright.schema import union_all
from tracewright.session import cut_lineage

# Event ids worth showing, pool sizes, quotas, per-reason limit.
HIGH_VALUE_IDS = ["4625", "4648", "4672", "4697", "4698", "4720", "4728", "4732", "4740", "7045", "1102"]
LOG_POOL, PREFETCH_POOL, SHORTCUT_POOL = 250, 150, 150
FAMILY_QUOTAS = {"evtx": 18, "prefetch": 8, "lnk": 7, "registry": 5, "hayabusa_detection": 2}
OTHER_QUOTA = 5
PER_REASON = 3
SHOWN = 40
SUPPORT = "Supports finding: "
REGISTRY_NOISE = "Registry key LastWrite observation"
# Presentation order of assessments.
ASSESSMENTS = ["HIGH_PRIORITY_REVIEW", "SUSPICIOUS", "NEEDS_REVIEW", "INSUFFICIENT_EVIDENCE", "LIKELY_BENIGN"]

_COLUMNS = [
    "event_uid", "timestamp", "timestamp_source", "source_tool", "artifact_type", "event_type", "path", "target_path",
    "executable", "command_line", "description", "hostname", "username", "windows_event_id", "registry_key",
    "registry_value_name", "registry_value_data", "attributes", "event_ts",
]


def findings_preview(findings: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """(finding_id, priority, title) of the first findings by id; a missing title falls back to type, then id."""
    title = F.coalesce(nonblank("title"), nonblank("finding_type"), nonblank("finding_id"), F.lit("Finding"))
    rows = findings.orderBy("finding_id")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("finding_id", F.coalesce("severity", F.lit("INFO")).alias("priority"), title.alias("title"))


def event_totals(events: DataFrame, *, preserved: bool | None = None) -> DataFrame:
    """One row: events, distinct uids and the trusted time range."""
    trusted = F.when(trusted_time(preserved), F.col("timestamp"))
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("event_uid").alias("unique_event_uids"),
        F.min(trusted).alias("first_timestamp"),
        F.max(trusted).alias("last_timestamp"),
    )


def group_counts(events: DataFrame, columns: tuple[str, ...] = ("source_tool", "artifact_type", "event_type")) -> DataFrame:
    """Counts per value of each column in one pass, as (metric, label, n)."""
    labels = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.coalesce(nonblank(c), F.lit("UNKNOWN")).alias("label"))
            for c in columns
        ]
    )
    return (
        events.select(F.explode(labels).alias("x"))
        .groupBy("x.metric", "x.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def evidence_display(payload: Column) -> Column:
    """Display text of an event by artifact type; ``payload`` is a map column."""
    observed = persistence_observation(F.col("windows_event_id"), payload, F.col("attributes"))
    mapped = F.coalesce(
        nonblank(F.try_element_at("attributes", F.lit("map_description"))),
        nonblank(F.try_element_at("attributes", F.lit("payload_data"))),
    )
    log_text = F.when(F.col("windows_event_id").isin(list(PERSISTENCE_LABELS)), observed).otherwise(
        F.when(~mapped.isin("{}", "[]", "null"), mapped)
    )
    name, data = nonblank("registry_value_name"), nonblank("registry_value_data")
    parts = [nonblank("registry_key"), F.coalesce(F.concat(name, F.lit("="), data), name)]
    registry_text = F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(" | ", *parts))
    special = F.when(F.col("artifact_type") == "evtx", log_text).when(
        F.col("artifact_type") == "registry", registry_text
    )
    return F.coalesce(
        special, activity_display("target_path", "path", "executable", "command_line", "description")
    )


def support_reasons(supports: DataFrame) -> DataFrame:
    """(event_uid, reason) from (event_uid, seq, title): the first two titles."""
    firsts = (
        supports.filter(clean("event_uid") != "")
        .select("event_uid", "seq", first_nonempty("title", F.lit("Investigation finding")).alias("title"))
        .groupBy("event_uid", "title")
        .agg(F.min("seq").alias("seq"))
    )
    return (
        top_n(firsts, ["event_uid"], [F.asc("seq"), F.asc("title")], 2)
        .groupBy("event_uid")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("t"))
        .select("event_uid", F.concat(F.lit(SUPPORT), F.array_join(F.col("t.title"), "; ")).alias("reason"))
    )


def evidence_streams(events: DataFrame, supports: DataFrame, *, preserved: bool | None = None) -> DataFrame:
    """Union of the four prioritised streams, the strongest reason per event.

    Finding-supported events are not limited here; every later step that ranks
    them keeps a fixed number per group. The streams are written once because
    those steps read them three times.
    """
    base = events.select(*_COLUMNS)
    reasons = support_reasons(supports)
    supported = base.join(reasons, "event_uid").withColumn("selection_priority", F.lit(100))
    tool = F.lower("source_tool")
    log_pool = (
        base.filter((tool == "evtxecmd") & F.col("windows_event_id").isin(HIGH_VALUE_IDS))
        .orderBy(F.desc("event_ts"), "event_uid").limit(LOG_POOL)
        .withColumn("reason", F.concat(F.lit("Windows security/activity event "), clean("windows_event_id")))
        .withColumn("selection_priority", F.lit(70))
    )
    prefetch_pool = (
        base.filter((tool == "pecmd") & ~F.coalesce("timestamp_source", F.lit("")).startswith("Source"))
        .orderBy(F.desc("event_ts"), "event_uid").limit(PREFETCH_POOL)
        .withColumn("reason", F.lit("Prefetch execution evidence"))
        .withColumn("selection_priority", F.lit(50))
    )
    shortcut_pool = (
        base.filter((tool == "lecmd") & trusted_time(preserved))
        .orderBy(F.desc("event_ts"), "event_uid").limit(SHORTCUT_POOL)
        .filter(specific_path(activity_display("target_path", "path", "executable", "description")))
        .withColumn("reason", F.lit("User file / shell activity"))
        .withColumn("selection_priority", F.lit(40))
    )
    pools = union_all([log_pool, prefetch_pool, shortcut_pool]).join(
        reasons.select("event_uid"), "event_uid", "left_anti"
    )
    rows = supported.unionByName(pools).withColumn(
        "_payload", without_blanks(parse_event_payload(F.try_element_at("attributes", F.lit("payload"))))
    )
    rows = rows.withColumn("display", evidence_display(F.col("_payload")))
    noise = (F.col("selection_priority") != 100) & (clean("description") == REGISTRY_NOISE)
    kept = rows.withColumn("_noise", noise).select(
        "event_uid", "timestamp", "artifact_type", "windows_event_id", "username", "executable", "display", "reason",
        "selection_priority", "_noise",
    )
    return cut_lineage(kept).filter((F.col("display") != "") & ~F.col("_noise")).drop("_noise")


def diversified_evidence(
    events: DataFrame, supports: DataFrame, *, preserved: bool | None = None, shown: int = SHOWN
) -> DataFrame:
    """Representative evidence: balanced per finding, deduplicated, with quotas.

    Steps keep this order: detections of findings that also have log rows are
    dropped, contextual repeats are dropped, each reason keeps three rows, then
    equal-looking rows are dropped, then family quotas apply. Each step is a
    rank limit, so no group is ever collected whole.
    """
    rows = evidence_streams(events, supports, preserved=preserved).withColumn(
        "family", F.coalesce(nonblank("artifact_type"), F.lit("other"))
    )
    order = [F.desc("selection_priority"), F.asc("timestamp"), F.asc("event_uid")]
    is_support = F.col("selection_priority") == 100
    with_logs = (
        rows.filter(is_support & (F.col("family") == "evtx")).select("reason").distinct().withColumn("_logged", F.lit(True))
    )
    rows = rows.join(with_logs, "reason", "left").filter(
        ~((F.col("family") == "hayabusa_detection") & F.coalesce("_logged", F.lit(False)))
    ).drop("_logged")

    context = rows.filter(~is_support)
    repeat_key = (
        F.when(F.col("family") == "evtx", F.concat_ws("|", F.lit("e"), clean("windows_event_id"), F.lower(clean("username"))))
        .when(F.col("family") == "prefetch", F.concat_ws("|", F.lit("p"), F.lower(first_nonempty("executable", "display"))))
        .otherwise(F.concat_ws("|", F.lit("u"), "event_uid"))
    )
    context = top_n(context.withColumn("_key", repeat_key), ["_key"], order, 1).drop("_key")
    supported = top_n(rows.filter(is_support), ["reason"], order, PER_REASON)
    balanced = supported.unionByName(context).withColumn("_looks", F.lower("display")).withColumn(
        "_second", F.left("timestamp", F.lit(19))
    )
    balanced = top_n(balanced, ["family", "_looks", "_second", "reason"], order, 1)
    biggest = max(FAMILY_QUOTAS.values())
    ranked = top_n(balanced, ["family"], order, biggest, "_family_rank").filter(
        F.col("_family_rank") <= lookup(FAMILY_QUOTAS, F.col("family"), OTHER_QUOTA)
    )
    return (
        ranked.orderBy(*order)
        .limit(shown)
        .orderBy("timestamp", "event_uid")
        .select("event_uid", "timestamp", "artifact_type", "display", F.col("reason").alias("selection_reason"), "selection_priority")
    )


def assessment_distribution(resolved: DataFrame) -> DataFrame:
    """Zero-filled counts in presentation order."""
    spark = resolved.sparkSession
    names = spark.createDataFrame(list(enumerate(ASSESSMENTS)), "position int, assessment string")
    counts = resolved.groupBy("assessment").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "assessment", "left").select(
        "position", "assessment", F.coalesce("n", F.lit(0)).alias("n")
    )


def gap_rules() -> list[tuple[Column, str]]:
    """Keyword buckets of evidence gaps, in order."""
    low = collapse("text")
    return [
        (low.contains("service") & low.rlike("origin|purpose|configuration"), "Service origin and configuration context"),
        (low.rlike("network|file system|filesystem"), "Network and file-system corroboration"),
        (low.rlike("user or process|process context|source of the user"), "User and process attribution"),
        (low.rlike("add the user|group membership|account"), "Account and privilege-change context"),
        (low.rlike("timestamp|subsequent actions|follow"), "Timing and follow-on activity"),
        (low.rlike("additional logs|artifacts|additional evidence"), "Additional logs and supporting artifacts"),
    ]


def step_rules() -> list[tuple[Column, str]]:
    """Keyword buckets of recommended steps, in order."""
    low = collapse("text")
    return [
        (
            low.contains("service") & low.rlike("configuration|behavior|modification"),
            "Validate suspicious services and service configuration",
        ),
        (
            low.rlike("command-line|command line") | (low.contains("service") & low.contains("installation")),
            "Review service execution and command-line context",
        ),
        (low.rlike("event log|related events|other suspicious service"), "Review related Windows event activity"),
        (low.rlike("domain admins|add the user|group|privilege"), "Validate account and privilege activity"),
        (low.rlike("administrator|user access|user account|logon"), "Review authentication and user activity"),
    ]


def bucket_texts(texts: DataFrame, rules: list[tuple[Column, str]], default: str) -> DataFrame:
    """Distinct texts per keyword bucket: (bucket, seq, text), first rule wins."""
    return (
        texts.filter(clean("text") != "")
        .select("seq", clean("text").alias("text"), first_match(rules, default).alias("bucket"))
        .groupBy("bucket", "text")
        .agg(F.min("seq").alias("seq"))
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by type and by severity as (metric, label, n)."""
    return group_counts(findings, ("finding_type", "severity"))


def top_findings(findings: DataFrame, severity_order: dict[str, int], *, n: int = 25) -> DataFrame:
    """Findings by severity, families, evidence and start."""
    return findings.orderBy(
        lookup(severity_order, F.col("severity"), 99),
        F.desc("independent_family_count"), F.desc("evidence_count"),
        F.coalesce("start_timestamp", F.lit("")), "finding_id",
    ).limit(n)

