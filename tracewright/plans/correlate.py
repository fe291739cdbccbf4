"""Linking events into a graph by shared keys and time distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.labels import confidence_from_score, norm_text, same_text
from tracewright.functions.text import (
    attribute,
    basename,
    clean,
    executable_names,
    first_nonempty,
    linkable_paths,
    norm_path,
)
from tracewright.functions.times import micros
from tracewright.operators.interval import crowded_anchors, interval_join
from tracewright.session import cut_lineage

# Rule version, windows in seconds, crowd limit, fan-out limit.
RULE_VERSION = "1.2"
DETECTION_WINDOW = 2.0
GENERIC_WINDOW = 1.0
REFERENCE_WINDOW_EVENTS = 5000
EXECUTABLE_FANOUT = 10

# Attribute names that may hold the record number or log file.
RECORD_ATTRIBUTES = [
    "record_id",
    "recordid",
    "event_record_id",
    "eventrecordid",
    "record_number",
    "recordnumber",
    "event_record_number",
]
FILE_ATTRIBUTES = ["evtx_file", "evtxfile", "file_name", "filename"]

# Tools whose events open a window, and the event id that makes
# a log event open one.
ANCHOR_TOOLS = ["pecmd", "recmd", "lecmd"]
ANCHOR_EVENT_ID = "7045"

# Shared-key relations. The tags keep both key kinds in one join
# and sort executables before paths.
PATH, EXECUTABLE = "SHARED_PATH_NEAR_TIME", "SHARED_EXECUTABLE_NEAR_TIME"
PATH_TAG, EXECUTABLE_TAG = "P|", "E|"
KEY_CHECK = "check"  # sets the second hash of a key apart from the first
LONGEST_KEY = (1 << 31) - 1

EDGE_COLUMNS = [
    "edge_uid",
    "run_id",
    "case_id",
    "event_uid_a",
    "event_uid_b",
    "source_tool_a",
    "source_tool_b",
    "ts_a",
    "ts_b",
    "relationship_type",
    "score",
    "confidence",
    "time_delta_seconds",
    "shared_keys",
    "reason",
    "rule_version",
]


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def detection_matches(events: DataFrame, *, window: float = DETECTION_WINDOW) -> DataFrame:
    """Detection to log event pairs: same event id and record number, close in time.

    Without an equal record number the score cannot reach the cut-off of 0.70
    (0.25 + 0.15 + 0.05 + 0.05 + 0.10 = 0.60), so the record number is a join key.
    """

    def side(tool: str, prefix: str, file_name: Column) -> DataFrame:
        return (
            events.filter((F.col("source_tool") == tool) & F.col("event_ts").isNotNull())
            .select(
                "case_id",
                clean("windows_event_id").alias("event_id"),
                attribute("attributes", *RECORD_ATTRIBUTES).alias("record"),
                F.col("event_uid").alias(f"{prefix}_uid"),
                F.col("source_tool").alias(f"{prefix}_tool"),
                F.col("event_ts").alias(f"{prefix}_ts"),
                micros(F.col("event_ts")).alias(f"{prefix}_us"),
                F.col("hostname").alias(f"{prefix}_host"),
                F.col("channel").alias(f"{prefix}_channel"),
                file_name.alias(f"{prefix}_file"),
            )
            .filter((F.col("event_id") != "") & (F.col("record") != ""))
        )

    anchors = side("hayabusa", "a", basename(attribute("attributes", *FILE_ATTRIBUTES)))
    logs = side(
        "evtxecmd",
        "c",
        basename(first_nonempty("provenance.source_evidence", "provenance.parser_output")),
    )
    pairs = interval_join(
        anchors,
        logs,
        ["case_id", "event_id", "record"],
        anchor_us="a_us",
        candidate_us="c_us",
        window_us=_us(window),
        salt_by=["c_uid"],
        hot_on=["case_id"],
    )
    delta = F.abs(F.col("a_us") - F.col("c_us")) / F.lit(1e6)
    host = same_text(F.col("a_host"), F.col("c_host"))
    channel = same_text(F.col("a_channel"), F.col("c_channel"))
    log_file = (F.col("a_file") != "") & (F.col("a_file") == F.col("c_file"))
    score = F.lit(0.25) + F.lit(0.45)
    score = score + F.when(delta <= 0.001, 0.15).when(delta <= 0.25, 0.10).otherwise(0.05)
    for flag, gain in ((host, 0.05), (channel, 0.05), (log_file, 0.10)):
        score = score + F.when(flag, gain).otherwise(0.0)
    shared = F.map_filter(
        F.create_map(
            F.lit("windows_event_id"), F.array("event_id"),
            F.lit("record_id"), F.array("record"),
            F.lit("hostname"), F.when(host, F.array("a_host")),
            F.lit("channel"), F.when(channel, F.array("a_channel")),
            F.lit("evtx_file"), F.when(log_file, F.array("a_file")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return (
        pairs.select(
            "case_id", "a_uid", "a_tool", "a_ts", "c_uid", "c_tool", "c_ts",
            delta.alias("delta"),
            F.least(score, F.lit(1.0)).alias("raw_score"),
            shared.alias("shared_keys"),
            F.lit("HAYABUSA_EVTX_MATCH").alias("relationship_type"),
            F.lit("Detection and log event share the event identity and its context.").alias("reason"),
            F.lit(1).alias("rule"),
        )
        .filter(F.col("raw_score") >= 0.70)
    )


def _text_hash(name: str) -> Column:
    """A hash that is equal where :func:`same_text` holds; null for blank text."""
    text = norm_text(F.col(name))
    return F.when(text != "", F.xxhash64(text))


def _normalized(events: DataFrame, *more: Column) -> DataFrame:
    """Event columns with normalized paths, computed once in their own step."""
    return events.select(
        "case_id", "event_uid", "source_tool", "event_ts",
        micros(F.col("event_ts")).alias("ts_us"),
        "hostname", "username",
        norm_path("executable").alias("_e"), norm_path("path").alias("_p"), norm_path("target_path").alias("_t"),
        *more,
    )


def generic_anchors(events: DataFrame) -> DataFrame:
    """Events that open a window, with the keys they may share. Events without
    keys stay in; exploding their empty key lists drops them later, while a
    filter here would compute the keys twice."""
    opens = F.col("source_tool").isin(ANCHOR_TOOLS) | (
        (F.col("source_tool") == "evtxecmd") & (F.col("windows_event_id") == ANCHOR_EVENT_ID)
    )
    rows = _normalized(
        events.filter(opens & F.col("event_ts").isNotNull()),
        norm_path(attribute("attributes", "executableinfo")).alias("_i"),
        norm_path(attribute("attributes", "imagepath")).alias("_m"),
        "registry_value_data",
    )
    names = executable_names("_e", "_p", "_t", "_i", "_m", text=F.col("registry_value_data"), tag=EXECUTABLE_TAG)
    return rows.select(
        "case_id", "event_uid", "source_tool", "event_ts", "ts_us", "hostname", "username",
        F.concat(linkable_paths("_p", "_t", tag=PATH_TAG), names).alias("keys"),
    )


def candidate_keys(events: DataFrame) -> DataFrame:
    """All timed events with their keys. Attributes and registry text count on
    the anchor side only."""
    rows = _normalized(events.filter(F.col("event_ts").isNotNull()))
    return rows.select(
        "case_id", "event_uid", "source_tool", "event_ts", "ts_us", "hostname", "username",
        F.concat(
            linkable_paths("_p", "_t", tag=PATH_TAG), executable_names("_e", "_p", "_t", tag=EXECUTABLE_TAG)
        ).alias("keys"),
    )


def uncrowded_anchors(events: DataFrame, *, window: float = GENERIC_WINDOW, limit: int | None = None) -> DataFrame:
    """Anchors whose window holds at most ``limit`` events of other tools; all anchors without a limit."""
    anchors = generic_anchors(events)
    if limit is None:
        return anchors
    return anchors.join(_crowded(anchors, events, window, limit), "event_uid", "left_anti")


def skipped_anchors(
    events: DataFrame, *, window: float = GENERIC_WINDOW, limit: int = REFERENCE_WINDOW_EVENTS
) -> DataFrame:
    """(case_id, event_uid, source_tool, event_ts) of the anchors that a crowd limit leaves out."""
    anchors = generic_anchors(events)
    kept = ["case_id", "event_uid", "source_tool", "event_ts"]
    return anchors.join(_crowded(anchors, events, window, limit), "event_uid", "left_semi").select(*kept)


def _crowded(anchors: DataFrame, events: DataFrame, window: float, limit: int) -> DataFrame:
    return crowded_anchors(
        anchors.select("case_id", "event_uid", "source_tool", "ts_us"),
        events.filter(F.col("event_ts").isNotNull()).select(
            "case_id", "source_tool", micros(F.col("event_ts")).alias("ts_us")
        ),
        uid="event_uid",
        group="case_id",
        source="source_tool",
        ts_us="ts_us",
        window_us=_us(window),
        limit=limit,
    )


def shared_key_matches(
    anchors: DataFrame,
    events: DataFrame,
    *,
    window: float = GENERIC_WINDOW,
    fanout: int = EXECUTABLE_FANOUT,
) -> DataFrame:
    """Anchor to event pairs of different tools with a common path or executable.

    Both key kinds go through one interval join, whose rows have a fixed size: a key is two 64-bit hashes, the
    first joins and the second must agree, and host and user are hashes as well. A pair with several common keys
    meets once per key. Executable pairs keep the best ``fanout`` per anchor; as all rows of a pair rank alike, each
    task limits an anchor to that many pairs before anything is shuffled. Only pairs that are kept look up the texts
    of their keys, among those of the anchor.
    """

    anchors = cut_lineage(anchors)  # read for the join and for the texts

    def side(rows: DataFrame, prefix: str, *more: Column) -> DataFrame:
        # The outer form keeps the planner from testing the size of the key list
        # below, which would compute all keys a second time.
        return rows.select(
            "case_id", F.explode_outer("keys").alias("key"),
            F.col("event_uid").alias(f"{prefix}_uid"), F.col("source_tool").alias(f"{prefix}_tool"),
            F.col("ts_us").alias(f"{prefix}_us"),
            _text_hash("hostname").alias(f"{prefix}_host"), _text_hash("username").alias(f"{prefix}_user"),
        ).filter(F.col("key").isNotNull()).select(
            "*", *more, F.xxhash64("key").alias("hash"), F.xxhash64(F.lit(KEY_CHECK), "key").alias(f"{prefix}_check")
        ).drop("key")

    pairs = interval_join(
        side(anchors, "a", F.col("key").startswith(PATH_TAG).alias("is_path")), side(candidate_keys(events), "c"),
        ["case_id", "hash"],
        anchor_us="a_us", candidate_us="c_us", window_us=_us(window),
        salt_by=["c_uid"], hot_on=["case_id"],
    )
    is_path = F.col("is_path")
    delta = F.abs(F.col("a_us") - F.col("c_us")) / F.lit(1e6)
    host = F.when(F.col("a_host") == F.col("c_host"), 0.05).otherwise(0.0)
    user = F.when(F.col("a_user") == F.col("c_user"), 0.05).otherwise(0.0)
    near = delta <= 0.10
    path_score = F.least(F.when(near, 0.90).otherwise(0.85) + host, F.lit(1.0))
    executable_score = F.least(F.when(near, 0.78).otherwise(0.72) + host + user, F.lit(0.90))
    scored = pairs.filter((F.col("a_tool") != F.col("c_tool")) & (F.col("a_check") == F.col("c_check"))).select(
        "case_id", "a_uid", "a_tool", "a_us", "c_uid", "c_tool", "c_us", "hash", "is_path", delta.alias("delta"),
        F.when(is_path, path_score).otherwise(executable_score).alias("raw_score"),
    )
    # A path pair is a group of its own, so that one ranking with a limit per task serves both kinds.
    best = Window.partitionBy("a_uid", F.when(is_path, F.col("c_uid"))).orderBy(F.desc("raw_score"), F.asc("delta"), F.asc("c_uid"))
    ranked = scored.withColumn("_rank", F.dense_rank().over(best)).filter(F.col("_rank") <= max(fanout, 1)).drop("_rank")
    ranked = ranked if fanout > 0 else ranked.filter(is_path)
    texts = anchors.select(F.col("event_uid").alias("a_uid"), F.explode_outer("keys").alias("key")).filter(F.col("key").isNotNull())
    texts = texts.select("a_uid", F.xxhash64("key").alias("hash"), F.substring("key", len(PATH_TAG) + 1, LONGEST_KEY).alias("key"))
    named = ranked.join(texts, ["a_uid", "hash"])
    pair = ["case_id", "a_uid", "a_tool", "a_us", "c_uid", "c_tool", "c_us", "delta", "raw_score", "is_path"]
    kept = named.groupBy(*pair).agg(F.sort_array(F.collect_set("key")).alias("common"))
    return kept.select(
        "case_id", "a_uid", "a_tool", F.timestamp_micros("a_us").alias("a_ts"),
        "c_uid", "c_tool", F.timestamp_micros("c_us").alias("c_ts"), "delta", "raw_score",
        F.create_map(F.when(is_path, "paths").otherwise("executables"), "common").alias("shared_keys"),
        F.when(is_path, PATH).otherwise(EXECUTABLE).alias("relationship_type"),
        F.when(is_path, "Events of different sources name the same path close in time.")
        .otherwise("Events of different sources name the same executable close in time.")
        .alias("reason"),
        F.when(is_path, 2).otherwise(3).alias("rule"),
    )


def edges_from_matches(matches: DataFrame, run_id: str) -> DataFrame:
    """Undirected edges; an edge found from both ends keeps its earliest anchor."""
    forward = F.col("a_uid") < F.col("c_uid")

    def ordered(a: str, c: str, first: bool) -> Column:
        return F.when(forward if first else ~forward, F.col(a)).otherwise(F.col(c))

    rows = matches.filter(F.col("a_uid") != F.col("c_uid")).select(
        "case_id",
        ordered("a_uid", "c_uid", True).alias("event_uid_a"),
        ordered("a_uid", "c_uid", False).alias("event_uid_b"),
        ordered("a_tool", "c_tool", True).alias("source_tool_a"),
        ordered("a_tool", "c_tool", False).alias("source_tool_b"),
        ordered("a_ts", "c_ts", True).alias("ts_a"),
        ordered("a_ts", "c_ts", False).alias("ts_b"),
        "relationship_type",
        F.round("raw_score", 4).alias("score"),
        confidence_from_score(F.col("raw_score")).alias("confidence"),
        F.col("delta").alias("time_delta_seconds"),
        "shared_keys",
        "reason",
        "rule",
        "a_ts",
        "a_uid",
    )
    keep = Window.partitionBy("event_uid_a", "event_uid_b", "relationship_type").orderBy(
        "rule", "a_ts", "a_uid"
    )
    identity = F.concat_ws(
        "|", F.lit(RULE_VERSION), "relationship_type", "event_uid_a", "event_uid_b"
    )
    return (
        rows.withColumn("_rank", F.row_number().over(keep))
        .filter(F.col("_rank") == 1)
        .withColumn("edge_uid", F.sha2(identity, 256))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("rule_version", F.lit(RULE_VERSION))
        .select(*EDGE_COLUMNS)
    )


def correlate(
    events: DataFrame,
    run_id: str,
    *,
    detection_window: float = DETECTION_WINDOW,
    generic_window: float = GENERIC_WINDOW,
    crowd_limit: int | None = None,
    fanout: int = EXECUTABLE_FANOUT,
) -> DataFrame:
    """All edges of the three link rules, one row per edge.

    No anchor is left out unless ``crowd_limit`` is given; ``skipped_anchors``
    lists those that a limit leaves out.
    """
    anchors = uncrowded_anchors(events, window=generic_window, limit=crowd_limit)
    matches = detection_matches(events, window=detection_window).unionByName(
        shared_key_matches(anchors, events, window=generic_window, fanout=fanout)
    )
    return edges_from_matches(matches, run_id)
