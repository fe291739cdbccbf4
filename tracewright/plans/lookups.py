"""Point, range and filtered reads of the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import clean, first_nonempty
from tracewright.functions.times import canonical_ts
from tracewright.operators.ranking import number_rows
from tracewright.operators.skew import ROWS_PER_SALT, SMALL_BYTES, parted_join, salted_join
from tracewright.session import cut_lineage

# The default result bound and the known placeholder time.
MAX_LIMIT = 10_000
LISTED = 1_000  # findings that are named beside an edge they hold
PART = 2_048  # findings, and edges, of a hub that meet as one group
RUN = 16  # findings that follow each other for one edge, before the next
PLACEHOLDER_TIME = "2000-01-01 00:00:00"
TARGET_SOURCES = ["LNK.TargetCreated", "LNK.TargetModified", "LNK.TargetAccessed"]
GENERIC_SHELL_PATHS = ["c:\\users", "c:", "", "\\"]
LIST_COLUMNS = [
    "event_uid", "timestamp", "timestamp_type", "artifact_type", "event_type", "source_tool", "hostname",
    "username", "executable", "path", "target_path", "windows_event_id", "provider", "channel",
    "detection_rule", "severity", "description",
]


def _bounded(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows (at most MAX_LIMIT), or all rows without a limit."""
    if limit is None:
        return rows
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}, or None for all rows")
    return rows.limit(limit)


def in_case(events: DataFrame, case_id: str | None) -> DataFrame:
    """Rows of one case; of all cases without one."""
    return events if case_id is None else events.filter(F.col("case_id") == case_id)


def get_event(events: DataFrame, case_id: str, uid: str) -> DataFrame:
    """One event with its attribute map and provenance, or no row."""
    return events.filter((F.col("case_id") == case_id) & (F.col("event_uid") == uid))


def events_by_time(
    events: DataFrame, start: str, end: str, *, case_id: str | None = None, limit: int | None = 1000
) -> DataFrame:
    """Events of a closed time range in time order."""
    low, high = canonical_ts(F.lit(start)), canonical_ts(F.lit(end))
    bounds = events.sparkSession.range(1).select(low.alias("low"), high.alias("high")).first()
    if bounds["low"] is None or bounds["high"] is None:
        raise ValueError("unsupported timestamp format")
    if bounds["low"] > bounds["high"]:
        raise ValueError("start_time must not be after end_time")
    rows = in_case(events, case_id).filter(F.col("event_ts").between(low, high)).orderBy("event_ts", "event_uid")
    return _bounded(rows, limit).select(*LIST_COLUMNS)


def events_by_artifact(
    events: DataFrame, artifact_type: str, *, case_id: str | None = None, limit: int | None = 1000
) -> DataFrame:
    """Events of one artifact type in raw timestamp order."""
    rows = in_case(events, case_id).filter(F.col("artifact_type") == artifact_type).orderBy("timestamp", "event_uid")
    return _bounded(rows, limit).select(
        "event_uid", "timestamp", "artifact_type", "event_type", "source_tool", "description"
    )


def windows_events(
    events: DataFrame,
    *,
    event_id: str | None = None,
    provider: str | None = None,
    channel: str | None = None,
    case_id: str | None = None,
    limit: int | None = 1000,
) -> DataFrame:
    """Log events under every filter that is given."""
    wanted = {"windows_event_id": event_id, "provider": provider, "channel": channel}
    conditions = [F.col("artifact_type") == "evtx"]
    conditions += [F.col(name) == value for name, value in wanted.items() if value is not None]
    rows = in_case(events, case_id).filter(reduce(lambda a, b: a & b, conditions)).orderBy("timestamp", "event_uid")
    return _bounded(rows, limit).select(
        "event_uid", "timestamp", "hostname", "windows_event_id", "provider", "channel", "username",
        "process_id", "description",
    )


def trusted_time(source_metadata_preserved: bool | None = None) -> Column:
    """Whether an event's time may be shown on a timeline.

    Shortcut source times are dropped only where the collection is known not
    to keep them; the placeholder time of shortcut targets is always dropped.
    """
    shortcut = F.col("source_tool") == "lecmd"
    placeholder = (
        shortcut & (F.col("timestamp") == PLACEHOLDER_TIME) & F.col("timestamp_source").isin(TARGET_SOURCES)
    )
    keep = ~placeholder
    if source_metadata_preserved is False:
        keep = keep & ~(shortcut & F.col("timestamp_source").startswith("LNK.Source"))
    return F.coalesce(keep, F.lit(True))


def activity_display(*columns: str) -> Column:
    """First non-blank of the display columns."""
    return first_nonempty(*(columns or ("target_path", "path", "executable", "command_line", "description")))


def specific_path(display: Column) -> Column:
    """False for blank and generic shell paths."""
    bare = F.lower(F.rtrim(clean(display), F.lit("\\/")))
    return ~bare.isin(GENERIC_SHELL_PATHS)


def timeline_examples(
    events: DataFrame, *, preserved: bool | None = None, case_id: str | None = None, limit: int | None = 500
) -> DataFrame:
    """First trusted events with a display text."""
    rows = in_case(events, case_id).filter(trusted_time(preserved)).orderBy("timestamp", "event_uid")
    return (
        _bounded(rows, limit)
        .select(
            "event_uid", "timestamp", "timestamp_source", "source_tool", "artifact_type",
            activity_display("path", "target_path", "executable", "command_line", "description").alias("display"),
        )
    )


def latest_run(runs: DataFrame, version_column: str, version: str) -> DataFrame:
    """The newest COMPLETED run of a version: one row per case, where runs name their case, or one row at most."""
    by = [c for c in ("case_id",) if c in runs.columns]
    return (
        runs.filter((F.col("status") == "COMPLETED") & (F.col(version_column) == version))
        .groupBy(*by)
        .agg(F.max_by("run_id", F.struct("completed_utc", "run_id")).alias("run_id"))
        .filter(F.col("run_id").isNotNull())
    )


def rows_of_latest_run(rows: DataFrame, runs: DataFrame, version_column: str, version: str) -> DataFrame:
    """Rows that belong to the newest completed run (of their case)."""
    newest = latest_run(runs, version_column, version)
    on = [c for c in newest.columns if c in rows.columns]
    return rows.join(newest, on, "left_semi")


def finding_evidence_lists(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of findings with their position in (role, family, uid) order, counted from 1 per finding.

    All rows are numbered by a range sort, and a finding's positions start at
    its smallest number, so no task needs a whole finding.
    """
    rows = evidence.join(findings.select("finding_id"), "finding_id", "left_semi").select(
        "finding_id", "evidence_role", "evidence_family", "event_uid"
    )
    order = [F.col(c) for c in ("finding_id", "evidence_role", "evidence_family", "event_uid")]
    numbered = number_rows(rows, order, "_number")
    first = numbered.groupBy("finding_id").agg(F.min("_number").alias("_first"))
    return (
        numbered.join(first, "finding_id")
        .withColumn("position", F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first")
    )


def incident_edges(
    edges: DataFrame, evidence: DataFrame, *, rows_per_salt: int = ROWS_PER_SALT, min_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Edges with either end in a finding's evidence, once per finding.

    An edge meets the findings at both ends. Those that hold its rarer end are told first; at the other end they are left out by
    name, so the rows of a hub event are never shuffled to find repeats. The edges of a hub and the findings that hold it are cut into
    parts that meet in pairs, so the rows come in runs of few findings and few edges. Edges of which more than LISTED findings hold the
    rarer end are told apart from repeats by a shuffle of their own rows.
    """
    shown = ["edge_uid", "relationship_type", "score", "confidence", "time_delta_seconds"]
    salt = {"salt_by": ["edge_uid"], "rows_per_salt": rows_per_salt, "min_bytes": min_bytes}
    held = cut_lineage(evidence.select("finding_id", "event_uid").filter("event_uid is not null").distinct())
    sizes = held.groupBy("event_uid").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(*shown, F.explode(F.array_distinct(F.array("event_uid_a", "event_uid_b"))).alias("event_uid"))
    end = F.struct("n", "event_uid")
    chosen = cut_lineage(
        salted_join(ends, sizes, ["event_uid"], **salt)
        .groupBy("edge_uid")
        .agg(F.min(end).alias("few"), F.max(end).alias("many"), F.first(F.struct(*shown[1:])).alias("rest"))
        .select("edge_uid", "rest.*", "few.n", F.col("few.event_uid").alias("few"), F.col("many.event_uid").alias("many"))
    )
    two, listed = F.col("few") != F.col("many"), F.col("n") <= LISTED

    # The findings of an event, RUN in a row: rows are made of them in the task that joins them, and few rows are moved.
    part = F.pmod(F.xxhash64("finding_id"), F.ceil(F.col("n") / PART)).alias("part")
    parts = held.join(sizes, "event_uid").groupBy("event_uid", part).agg(F.sort_array(F.collect_list("finding_id")).alias("ids"))
    at = F.explode(F.sequence(F.lit(0), (F.size("ids") - 1).cast("int"), F.lit(RUN)))
    blocks = cut_lineage(parts.select("event_uid", "ids", at.alias("at")).select("event_uid", F.slice("ids", F.col("at") + 1, F.lit(RUN)).alias("ids")))

    def holders(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("event_uid", F.col(name)).drop("few" if name == "many" else "many")
        met = parted_join(blocks, rows, ["event_uid"], left_by=["ids"], right_by=["edge_uid"], left_rows=PART // RUN, right_rows=PART)
        return met.select(F.explode("ids").alias("finding_id"), *rows.columns)

    doubles = holders(chosen.filter(two & listed).withColumn("other", F.col("many")).select("edge_uid", "few", "many", "other"), "few")
    doubles = salted_join(doubles.select("finding_id", "edge_uid", F.col("other").alias("event_uid")), held, ["finding_id", "event_uid"], "left_semi", **salt)
    known = doubles.groupBy("edge_uid").agg(F.collect_list("finding_id").alias("known"))
    second = holders(chosen.filter(two & listed).join(known, "edge_uid", "left"), "many")
    second = second.filter(~F.coalesce(F.array_contains("known", F.col("finding_id")), F.lit(False)))
    crowded = chosen.filter(two & ~listed)
    either = holders(crowded, "few").select("finding_id", *shown).unionByName(holders(crowded, "many").select("finding_id", *shown))
    first = holders(chosen.filter(~two | listed), "few")
    return first.select("finding_id", *shown).unionByName(second.select("finding_id", *shown)).unionByName(
        either.dropDuplicates(["finding_id", "edge_uid"])
    )
