"""Windows activity tables: logons, execution, shell items, persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import lookup
from tracewright.functions.payload import (
    AUTH_LABELS,
    PERSISTENCE_LABELS,
    classify_auth_identity,
    parse_event_payload,
    persistence_observation,
    without_blanks,
)
from tracewright.functions.text import first_nonempty
from tracewright.plans.lookups import activity_display, specific_path, trusted_time

# List sizes and class order.
AUTH_POOL, AUTH_SHOWN = 250, 30
PREFETCH_SHOWN = 40
PROCESS_SHOWN = 30
SHELL_POOL, SHELL_SHOWN = 100, 30
PERSISTENCE_POOL, PERSISTENCE_SHOWN = 100, 50
IDENTITY_ORDER = {"USER / OTHER": 0, "UNKNOWN": 1}


def log_events(events: DataFrame) -> DataFrame:
    """Events of the log parser."""
    return events.filter(F.lower("source_tool") == "evtxecmd")


def label_counts(events: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Count per labelled event id; ids without events count zero.

    The label table is a constant of a few rows.
    """
    spark = events.sparkSession
    names = spark.createDataFrame(list(labels.items()), "event_id string, label string")
    counts = (
        log_events(events)
        .filter(F.col("windows_event_id").isin(list(labels)))
        .groupBy(F.col("windows_event_id").alias("event_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return names.join(counts, "event_id", "left").select(
        "event_id", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def newest_auth(events: DataFrame, *, pool: int = AUTH_POOL) -> DataFrame:
    """The newest logon-related events with their identity class."""
    return (
        log_events(events)
        .filter(F.col("windows_event_id").isin(list(AUTH_LABELS)))
        .orderBy(F.desc("event_ts"), "event_uid")
        .limit(pool)
        .select(
            "event_uid", "timestamp", "event_ts", F.col("windows_event_id").alias("event_id"), "username", "hostname",
            "description", classify_auth_identity(F.col("username")).alias("identity_class"),
        )
    )


def identity_counts(newest: DataFrame) -> DataFrame:
    """Events per identity class of a newest-events pool."""
    return newest.groupBy("identity_class").agg(F.count(F.lit(1)).alias("n"))


def ranked_auth(newest: DataFrame, *, shown: int = AUTH_SHOWN) -> DataFrame:
    """User events first, then unknown, then service; newest first inside."""
    order = lookup(IDENTITY_ORDER, F.col("identity_class"), 2)
    return newest.orderBy(order, F.desc("timestamp"), "event_uid").limit(shown)


def attribute_pivot(events: DataFrame) -> DataFrame:
    """Prefetch rows with their hash, run count and run field, LastRun only."""
    return (
        events.filter(F.lower("source_tool") == "pecmd")
        .select(
            "event_uid", "timestamp", "executable", "path",
            F.try_element_at("attributes", F.lit("prefetch_hash")).alias("prefetch_hash"),
            F.try_element_at("attributes", F.lit("run_count")).alias("run_count"),
            F.try_element_at("attributes", F.lit("run_timestamp_field")).alias("run_timestamp_field"),
        )
        .filter(F.col("run_timestamp_field") == "LastRun")
    )


def latest_prefetch(events: DataFrame) -> DataFrame:
    """Newest row per prefetch hash (else executable, else event)."""
    keyed = attribute_pivot(events).withColumn(
        "run_key", first_nonempty("prefetch_hash", "executable", "event_uid")
    )
    # The first of equal timestamps wins: order by time, then by descending uid.
    latest = keyed.groupBy("run_key").agg(
        F.max("timestamp").alias("timestamp"),
        F.min_by(
            F.struct("event_uid", "executable", "path", "prefetch_hash", "run_count"),
            F.struct(-F.unix_micros(F.try_to_timestamp("timestamp")), F.col("event_uid")),
        ).alias("r"),
    )
    return latest.select("run_key", "timestamp", "r.*").withColumn(
        "runs", F.coalesce(F.expr("try_cast(run_count AS BIGINT)"), F.lit(0))
    )


def top_prefetch(events: DataFrame, *, shown: int = PREFETCH_SHOWN) -> DataFrame:
    """Most-run programs."""
    return latest_prefetch(events).orderBy(F.desc("runs"), F.desc("timestamp"), "event_uid").limit(shown)


def process_creation(events: DataFrame, *, shown: int = PROCESS_SHOWN) -> DataFrame:
    """Newest process-creation log events."""
    return (
        log_events(events)
        .filter(F.col("windows_event_id") == "4688")
        .orderBy(F.desc("event_ts"), "event_uid")
        .limit(shown)
        .select("event_uid", "timestamp", "username", "executable", "command_line", "path", "description")
    )


def shell_items(
    events: DataFrame, *, preserved: bool | None = None, pool: int = SHELL_POOL, shown: int = SHELL_SHOWN
) -> DataFrame:
    """Newest shortcut items, distinct by (time, text, time source)."""
    newest = (
        events.filter((F.lower("source_tool") == "lecmd") & trusted_time(preserved))
        .orderBy(F.desc("event_ts"), "event_uid")
        .limit(pool)
        .withColumn("display_value", activity_display("target_path", "path", "executable", "description"))
        .filter((F.col("display_value") != "") & specific_path(F.col("display_value")))
    )
    distinct = newest.groupBy("timestamp", "display_value", "timestamp_source").agg(
        F.min("event_uid").alias("event_uid"), F.max("event_ts").alias("event_ts")
    )
    return distinct.orderBy(F.desc("event_ts"), "event_uid").limit(shown)


def persistence_events(
    events: DataFrame, *, pool: int = PERSISTENCE_POOL, shown: int = PERSISTENCE_SHOWN
) -> DataFrame:
    """Newest persistence and account events with a readable observation."""
    newest = (
        log_events(events)
        .filter(F.col("windows_event_id").isin(list(PERSISTENCE_LABELS)))
        .orderBy(F.desc("event_ts"), "event_uid")
        .limit(pool)
    )
    payload = without_blanks(parse_event_payload(F.try_element_at("attributes", F.lit("payload"))))
    return (
        newest.withColumn("payload", payload)
        .select(
            "event_uid", "timestamp", "event_ts", F.col("windows_event_id").alias("event_id"), "username", "hostname",
            "description",
            persistence_observation(F.col("windows_event_id"), F.col("payload"), F.col("attributes")).alias("observation"),
        )
        .orderBy(F.desc("event_ts"), "event_uid")
        .limit(shown)
    )

