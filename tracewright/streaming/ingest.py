"""Continuous import: file stream, keyed deduplication, append of new events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.plans.ingest import (
    COMPACT_FROM,
    commit_batch,
    compact,
    missing_events,
    read_events,
    stored_alike,
    untimed_rejects,
    write_batch,
    write_rejects,
)
from tracewright.schema import EVENT_SCHEMA
from tracewright.session import cut_lineage


def stream_events(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Canonical events arriving as JSON line files."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _append_batch(batch: DataFrame, batch_id: int, store: str, stream: str, compact_from: int) -> None:
    """Write the uids the store lacks as this batch's own folder, and events
    without a readable time as its rejects. A batch that runs again replaces
    both and does not count its own rows as stored."""
    name = f"stream-{stream}-{batch_id}"
    rows = cut_lineage(batch)
    timed, untimed = rows.filter(F.col("event_ts").isNotNull()), rows.filter(F.col("event_ts").isNull())
    stored = read_events(batch.sparkSession, store, without_batch=name)
    write_batch(missing_events(timed, stored_alike(timed, stored)), store, name)
    if not untimed.isEmpty():
        write_rejects(untimed_rejects(untimed), store, name)
    commit_batch(batch.sparkSession, store, name)
    compact(batch.sparkSession, store, least_batches=compact_from)


def start_ingest(
    events: DataFrame, store: str, checkpoint: str, *, once: bool = False, compact_from: int = COMPACT_FROM
) -> StreamingQuery:
    """Start the import.

    Every batch keeps one row per uid and drops the uids that the store has, so
    duplicates go however late they come and no state grows in memory. Only the
    cases, tools and time range of the batch are read from the store. Batches are named by
    the checkpoint, so several streams may feed one store; from ``compact_from`` of them on they are compacted.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    writer = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .foreachBatch(lambda batch, batch_id: _append_batch(batch, batch_id, store, stream, compact_from))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
