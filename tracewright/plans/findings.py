"""Findings from candidates, clusters, detections, command history and shortcuts.

A finding is a header row. Its members and its distinct values (executables,
paths, rules, services) are rows of their own tables, because neither has a
size bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import command_lead_kind, normalize_severity, severity_rank
from tracewright.functions.text import PREFETCH_NAME, nonblank, trim
from tracewright.operators.skew import salted_join
from tracewright.session import cut_lineage

FINDINGS_VERSION = "1.7"

# Extension classes and user-writable path markers of shortcut targets.
SCRIPT_EXTENSIONS = [
    ".ps1", ".psm1", ".bat", ".cmd", ".vbs", ".vbe", ".js", ".jse", ".wsf", ".wsh", ".hta", ".jar", ".msi", ".msp",
]
DIRECT_EXTENSIONS = [".exe", ".com", ".scr", ".dll", ".cpl"]
PACKAGE_EXTENSIONS = [".zip", ".rar", ".7z", ".iso", ".img", ".cab"]
DIRECT_MARKERS = ["\\downloads\\", "\\desktop\\", "\\temp\\", "\\users\\public\\"]
WRITABLE_MARKERS = [
    "\\downloads\\", "\\desktop\\", "\\appdata\\", "\\temp\\", "\\users\\public\\", "\\programdata\\",
]

# Where a service name can stand in an attribute.
SERVICE_KEYS = ["service_name", "servicename", "svc"]
SERVICE_PATTERNS = [
    r'(?i)"ServiceName"\s*,\s*"#text"\s*:\s*"([^"]+)"',
    r"(?i)['\"]Svc['\"]\s*:\s*['\"]([^'\"]+)['\"]",
    r'(?i)"PayloadData1"\s*:\s*"Name:\s*([^"]+)"',
]

FINDING_COLUMNS = [
    "finding_id", "run_id", "case_id", "finding_type", "state", "confidence", "severity", "title", "summary",
    "source_kind", "source_id", "start_timestamp", "end_timestamp", "independent_family_count",
    "evidence_count", "evidence_families", "source_tools",
]
EVIDENCE_COLUMNS = ["finding_id", "event_uid", "source_tool", "evidence_family", "evidence_role"]
VALUE_COLUMNS = ["finding_id", "kind", "value"]

# The summaries are this library's own wording.
SUMMARIES = {
    "CROSS_ARTIFACT_ACTIVITY_LEAD": "Independent artifact families name the same executable or path close in time. "
    "A lead for review; it proves neither execution nor intent.",
    "CORE_CROSS_ARTIFACT_LEAD": "Independent evidence families support the same core cluster. "
    "A lead for review; no judgement on intent is made.",
    "HAYABUSA_DETECTION_LEAD": "Detection rules fired on log events of this cluster. Detections and the log they "
    "read are one evidence family and count once.",
    "STANDALONE_ARTIFACT_LEAD": "A shortcut points to a target in a user-writable path. "
    "A lead for review; a shortcut alone does not prove execution.",
}


def finding_id(kind: str, source: Column) -> Column:
    """Stable finding key."""
    return F.sha2(F.concat_ws("|", F.lit(FINDINGS_VERSION), F.lit(kind), source), 256)


def _header(rows: DataFrame, kind: str, run_id: str, **columns: Column | str) -> DataFrame:
    defaults = {
        "run_id": F.lit(run_id),
        "finding_type": F.lit(kind),
        "state": F.lit("REVIEW_REQUIRED"),
        "severity": F.lit("UNASSESSED"),
        "summary": F.lit(SUMMARIES.get(kind, "")),
    }
    chosen = {**defaults, **{k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}}
    return rows.select(
        *[chosen[c].alias(c) if c in chosen else F.col(c) for c in FINDING_COLUMNS]
    )


def covered_candidates(
    candidate_events: DataFrame, clusters: DataFrame, cluster_events: DataFrame
) -> DataFrame:
    """Candidates whose members all lie inside one multi-family cluster.

    Relational division by counting: members shared with a cluster equal the
    candidate's size.
    """
    strong = clusters.filter(F.col("independent_family_count") >= 2).select("cluster_id")
    core = cluster_events.join(strong, "cluster_id", "left_semi").select("cluster_id", "event_uid")
    sizes = candidate_events.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("size"))
    shared = (
        candidate_events.join(core, "event_uid")
        .groupBy("candidate_id", "cluster_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.join(sizes, "candidate_id")
        .filter(F.col("shared") == F.col("size"))
        .select("candidate_id")
        .distinct()
    )


def _raw_paths(members: DataFrame, key: str) -> DataFrame:
    return (
        members.select(key, F.explode(F.array(trim("path"), trim("target_path"))).alias("value"))
        .filter(F.col("value") != "")
        .select(key, F.lit("PATH").alias("kind"), "value")
    )


def _times(start: str = "start_ts", end: str = "end_ts") -> dict[str, Column]:
    pattern = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return {
        "start_timestamp": F.date_format(start, pattern),
        "end_timestamp": F.date_format(end, pattern),
    }


def candidate_leads(
    events: DataFrame,
    candidates: DataFrame,
    candidate_events: DataFrame,
    candidate_keys: DataFrame,
    clusters: DataFrame,
    cluster_events: DataFrame,
    run_id: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead per candidate that no multi-family cluster covers."""
    kind = "CROSS_ARTIFACT_ACTIVITY_LEAD"
    covered = covered_candidates(candidate_events, clusters, cluster_events)
    kept = candidates.join(covered, "candidate_id", "left_anti")
    fid = finding_id(kind, F.col("candidate_id"))
    names = (
        candidate_keys.filter(F.col("kind") == "executables")
        .groupBy("candidate_id")
        .agg(F.count(F.lit(1)).alias("_names"), F.min("value").alias("_name"))
    )
    base = "Cross-artifact activity correlation"
    title = F.when(F.col("_names") == 1, F.concat(F.lit(base + ": "), F.col("_name"))).otherwise(base)
    headers = _header(
        kept.join(names, "candidate_id", "left"),
        kind, run_id,
        finding_id=fid, title=title, confidence="MEDIUM", source_kind="CANDIDATE_CLUSTER",
        source_id=F.col("candidate_id"), evidence_count=F.col("event_count"), **_times(),
    )
    members = candidate_events.join(covered, "candidate_id", "left_anti")
    evidence = members.select(
        fid.alias("finding_id"), "event_uid", "source_tool", "evidence_family",
        F.when(F.col("evidence_family") == "PREFETCH", "EXECUTION_EVIDENCE")
        .otherwise("FILESYSTEM_EVIDENCE").alias("evidence_role"),
    )
    shared = candidate_keys.join(covered, "candidate_id", "left_anti").select(
        "candidate_id",
        F.when(F.col("kind") == "executables", "EXECUTABLE").otherwise("PATH").alias("kind"),
        "value",
    )
    paths = _raw_paths(members.join(events.select("event_uid", "path", "target_path"), "event_uid"), "candidate_id")
    values = shared.unionByName(paths).distinct().select(fid.alias("finding_id"), "kind", "value")
    return headers, evidence, values


def service_names(members: DataFrame, key: str) -> DataFrame:
    """Distinct service names found in the attributes of each group's events."""
    pairs = members.select(key, F.explode("attributes").alias("name", "text")).filter(F.col("text") != "")
    direct = F.when(F.lower(F.trim("name")).isin(SERVICE_KEYS), trim("text"))
    found = [trim(F.regexp_extract("text", p, 1)) for p in SERVICE_PATTERNS]
    return (
        pairs.select(key, F.explode(F.array(direct, *found)).alias("value"))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .select(key, F.lit("SERVICE").alias("kind"), "value")
        .distinct()
    )


def core_leads(
    events: DataFrame, clusters: DataFrame, cluster_events: DataFrame, run_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead per cluster with at least two independent families."""
    kind = "CORE_CROSS_ARTIFACT_LEAD"
    strong = clusters.filter(F.col("independent_family_count") >= 2)
    fid = finding_id(kind, F.col("cluster_id"))
    members = cluster_events.join(strong.select("cluster_id"), "cluster_id", "left_semi")
    facts = events.select(
        "event_uid", "executable", "path", "target_path", "detection_rule", "description", "attributes"
    )
    detailed = members.join(facts, "event_uid")
    paths = _raw_paths(detailed, "cluster_id")
    base_name = F.lower(F.regexp_extract(F.translate("value", "\\", "/"), r"([^/]*)$", 1))
    prefetch = paths.select("cluster_id", F.regexp_extract(base_name, PREFETCH_NAME, 1).alias("value"))
    executables = (
        detailed.select("cluster_id", trim("executable").alias("value"))
        .unionByName(prefetch)
        .filter(F.col("value") != "")
        .select("cluster_id", F.lit("EXECUTABLE").alias("kind"), "value")
    )
    rules = detailed.filter(F.col("source_tool") == "hayabusa").select(
        "cluster_id",
        F.lit("RULE").alias("kind"),
        trim(F.coalesce(F.nullif("detection_rule", F.lit("")), "description")).alias("value"),
    ).filter(F.col("value") != "")
    by_cluster = (
        executables.unionByName(paths).unionByName(rules).distinct()
        .unionByName(service_names(detailed, "cluster_id"))
    )
    first_name = executables.groupBy("cluster_id").agg(F.min("value").alias("_name"))
    base = "Cross-artifact forensic lead"
    headers = _header(
        strong.join(first_name, "cluster_id", "left"),
        kind, run_id,
        finding_id=fid,
        title=F.concat(F.lit(base), F.coalesce(F.concat(F.lit(": "), F.col("_name")), F.lit(""))),
        confidence="HIGH", source_kind="CORE_CLUSTER", source_id=F.col("cluster_id"),
        evidence_count=F.col("event_count"), **_times(),
    )
    evidence = members.select(
        fid.alias("finding_id"), "event_uid", "source_tool", "evidence_family",
        F.when(F.col("source_tool") == "hayabusa", "DETECTION_ENRICHMENT")
        .when(F.col("membership_role") == "CORE", "CORE_EVIDENCE")
        .otherwise("CORROBORATING_ATTACHMENT").alias("evidence_role"),
    )
    return headers, evidence, by_cluster.select(fid.alias("finding_id"), "kind", "value")


def history_leads(events: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead per command-history event that matches a keyword rule."""
    kind = "POWERSHELL_HISTORY_LEAD"
    rows = (
        events.filter(F.col("source_tool") == "powershell_history")
        .withColumn("_kind", command_lead_kind("command_line"))
        .filter(F.col("_kind").isNotNull())
    )
    fid = finding_id(kind, F.col("event_uid"))
    headers = _header(
        rows, kind, run_id,
        finding_id=fid,
        title=F.concat(F.lit("PowerShell history lead: "), F.col("_kind")),
        summary=F.concat(
            F.lit("Command history holds: "), trim("command_line"),
            F.lit(" History has no time per command; no judgement on intent is made."),
        ),
        confidence="HIGH", source_kind="EVIDENCE_EVENT", source_id=F.col("event_uid"),
        start_timestamp=F.lit(None).cast("string"), end_timestamp=F.lit(None).cast("string"),
        independent_family_count=F.lit(1).cast("long"), evidence_count=F.lit(1).cast("long"),
        evidence_families=F.array(F.lit("POWERSHELL_HISTORY")), source_tools=F.array(F.lit("powershell_history")),
    )
    evidence = rows.select(
        fid.alias("finding_id"), "event_uid", "source_tool",
        F.lit("POWERSHELL_HISTORY").alias("evidence_family"),
        F.lit("COMMAND_HISTORY_EVIDENCE").alias("evidence_role"),
    )
    values = rows.filter(F.col("path") != "").select(
        fid.alias("finding_id"), F.lit("PATH").alias("kind"), F.col("path").alias("value")
    )
    return headers, evidence, values


def detection_rollup(events: DataFrame, cluster_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-cluster maximum severity, rule count and first rule; distinct rules)."""
    members = cluster_events.filter(F.col("source_tool") == "hayabusa").select("cluster_id", "event_uid")
    rows = members.join(
        events.select("event_uid", "severity", "detection_rule", "description"), "event_uid"
    ).select(
        "cluster_id",
        normalize_severity("severity").alias("severity"),
        trim(
            F.coalesce(
                F.nullif("detection_rule", F.lit("")), F.nullif("description", F.lit("")),
                F.lit("Unnamed Hayabusa rule"),
            )
        ).alias("rule"),
    )
    # One row per (cluster, rule) first: a hot cluster shrinks before its own roll-up.
    by_rule = rows.groupBy("cluster_id", "rule").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    rolled = by_rule.groupBy("cluster_id").agg(
        F.max("rank").alias("rank"),
        F.count(F.lit(1)).alias("rule_count"),
        F.min("rule").alias("first_rule"),
    )
    return rolled, by_rule.select("cluster_id", "rule")


def detection_leads(
    events: DataFrame, clusters: DataFrame, cluster_events: DataFrame, run_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead per cluster with a detection of at least MEDIUM severity."""
    kind = "HAYABUSA_DETECTION_LEAD"
    rolled, rules = detection_rollup(events, cluster_events)
    kept = rolled.filter(F.col("rank") >= 2)
    level = F.when(F.col("rank") == 4, "CRITICAL").when(F.col("rank") == 3, "HIGH").otherwise("MEDIUM")
    more = F.when(
        F.col("rule_count") > 1,
        F.concat(F.lit(" (+"), (F.col("rule_count") - 1).cast("string"), F.lit(" related)")),
    ).otherwise("")
    fid = finding_id(kind, F.col("cluster_id"))
    headers = _header(
        clusters.join(kept, "cluster_id"), kind, run_id,
        finding_id=fid, title=F.concat(F.lit("Detection lead: "), F.col("first_rule"), more),
        confidence="HIGH", severity=level, source_kind="CORE_CLUSTER", source_id=F.col("cluster_id"),
        evidence_count=F.col("event_count"), **_times(),
    )
    ids = kept.select("cluster_id")
    evidence = salted_join(cluster_events, ids, ["cluster_id"], "left_semi", salt_by=["event_uid"]).select(
        fid.alias("finding_id"), "event_uid", "source_tool", "evidence_family",
        F.when(F.col("source_tool") == "hayabusa", "DETECTION_ENRICHMENT")
        .otherwise("UNDERLYING_EVTX").alias("evidence_role"),
    )
    values = rules.join(ids, "cluster_id", "left_semi").select(
        fid.alias("finding_id"), F.lit("RULE").alias("kind"), F.col("rule").alias("value")
    )
    return headers, evidence, values


def path_suffix(path: Column) -> Column:
    """Lower-case extension of the last path segment, blank if none."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def is_lead_target(path: Column) -> Column:
    """Whether a lower-case backslash path is a lead by extension and place."""

    def holds(markers: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [path.contains(m) for m in markers])

    suffix = path_suffix(path)
    known = suffix.isin(SCRIPT_EXTENSIONS + PACKAGE_EXTENSIONS) | (
        suffix.isin(DIRECT_EXTENSIONS) & holds(DIRECT_MARKERS)
    )
    return known & holds(WRITABLE_MARKERS)


def shortcut_targets(events: DataFrame) -> DataFrame:
    """Shortcut target events that qualify as leads, with their normalized target."""
    rows = events.filter(
        (F.col("source_tool") == "lecmd")
        & F.col("timestamp_source").startswith("LNK.Target")
        & nonblank("target_path").isNotNull()
    ).withColumn("target", F.lower(F.translate(trim("target_path"), "/", "\\")))
    return rows.filter(is_lead_target(F.col("target")))


def standalone_leads(
    events: DataFrame, run_id: str, *, without_cases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One lead per case and qualifying shortcut target.

    Finding ids hash the case too, as one table holds many cases. Cases of
    ``without_cases`` give no lead.
    """
    kind = "STANDALONE_ARTIFACT_LEAD"
    rows = shortcut_targets(events)
    if without_cases is not None:
        rows = rows.join(without_cases.select("case_id").distinct(), "case_id", "left_anti")
    grouped = rows.groupBy("case_id", "target").agg(
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
        F.count_distinct("event_uid").alias("evidence_count"),
        F.min_by("target_path", F.struct("target_path", "timestamp", "event_uid")).alias("original"),
    )
    suffix = path_suffix(F.col("target"))
    runnable = suffix.isin(SCRIPT_EXTENSIONS + DIRECT_EXTENSIONS)
    script = suffix.isin(SCRIPT_EXTENSIONS)
    source = F.concat_ws(
        "|", F.lit("LNK"), F.when(runnable, "EXECUTABLE_OR_SCRIPT").otherwise("ARCHIVE_OR_PACKAGE"), "target"
    )
    fid = finding_id(kind, F.concat_ws("|", F.col("case_id"), source))
    # The file name of the title is taken after the last slash only, as paths are kept raw.
    name = F.regexp_extract("original", r"([^/]*)$", 1)
    headers = _header(
        grouped, kind, run_id,
        finding_id=fid,
        title=F.concat(
            F.when(runnable, "Standalone LNK execution artifact lead: ")
            .otherwise("Standalone LNK package artifact lead: "),
            name,
        ),
        confidence=F.when(runnable, "MEDIUM").otherwise("LOW"),
        source_kind="STANDALONE_ARTIFACT", source_id=source,
        independent_family_count=F.lit(1).cast("long"),
        evidence_families=F.array(F.lit("LNK")), source_tools=F.array(F.lit("lecmd")),
    )
    evidence = rows.select(
        fid.alias("finding_id"), "event_uid", "source_tool",
        F.lit("LNK").alias("evidence_family"),
        F.when(script, "STANDALONE_EXECUTION_LEAD").otherwise("STANDALONE_PACKAGE_LEAD").alias("evidence_role"),
    ).distinct()
    values = grouped.select(
        fid.alias("finding_id"),
        F.explode(F.when(script, F.array(F.lit("EXECUTABLE"), F.lit("PATH"))).otherwise(F.array(F.lit("PATH")))).alias("kind"),
        F.col("original").alias("value"),
    )
    return headers, evidence, values


def build_findings(
    events: DataFrame,
    clusters: DataFrame,
    cluster_events: DataFrame,
    candidates: DataFrame,
    candidate_events: DataFrame,
    candidate_keys: DataFrame,
    run_id: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, finding_evidence, finding_values) of all producers.

    Shortcut leads are a fallback: they are made for the cases in which the
    other producers made nothing.
    """
    parts = [
        candidate_leads(events, candidates, candidate_events, candidate_keys, clusters, cluster_events, run_id),
        core_leads(events, clusters, cluster_events, run_id),
        history_leads(events, run_id),
        detection_leads(events, clusters, cluster_events, run_id),
    ]
    findings, evidence, values = (
        reduce(lambda a, b: a.unionByName(b), [p[i] for p in parts]) for i in range(3)
    )
    findings = cut_lineage(findings)
    lone = standalone_leads(events, run_id, without_cases=findings)
    return findings.unionByName(lone[0]), evidence.unionByName(lone[1]), values.unionByName(lone[2])


def linked_evidence_count(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence links of the given findings."""
    return evidence.join(findings.select("finding_id"), "finding_id", "left_semi").agg(
        F.count(F.lit(1)).alias("links")
    )


def detection_severities(events: DataFrame, uids: DataFrame) -> DataFrame:
    """Severity histogram of referenced detection events."""
    return (
        events.filter(F.col("source_tool") == "hayabusa")
        .join(uids, "event_uid", "left_semi")
        .groupBy(normalize_severity("severity").alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

