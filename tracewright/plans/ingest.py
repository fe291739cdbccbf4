"""Importing parser outputs into the event store.

The store is a parquet table partitioned by import batch, case and tool. A
batch overwrites its own folder and counts once its commit is written, one small
file that appears whole; so an import that runs again after a failure leaves no
doubles, and nobody reads half a batch. Many small batches are compacted into one
that replaces them in the same way. The ledger is a small table with one row per
import attempt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.skew import first_by, planned_bytes
from tracewright.schema import EVENT_SCHEMA, union_all
from tracewright.session import cut_lineage
from tracewright.sources.inventory import list_files
from tracewright.sources.parsers import ADAPTERS, limit_rows, number_records, read_detections, split_unparseable

# Ledger states, gap-fill order and its states.
PARTIAL, COMPLETED = "PARTIAL", "COMPLETED"
GAP_FILL_ORDER = ["recmd", "lecmd", "hayabusa"]
NO_SOURCE, ALREADY, FILLED = "SKIPPED_NO_SOURCE", "ALREADY_COMPLETE", "COMPLETED_MISSING_EVENTS"

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("import_id", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("source_tool", T.StringType()),
        T.StructField("parser_output", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("last_source_row", T.LongType()),
        T.StructField("source_rows_processed", T.LongType()),
        T.StructField("events_inserted", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


class ImportRefused(RuntimeError):
    """The import would not be safe: changed source or finished import."""


class InvalidEvents(RuntimeError):
    """Events break an import rule."""


def normalize(spark: SparkSession, inputs: dict[str, str | list[str]], case_id: str) -> DataFrame:
    """Union of the given tools' events."""
    return union_all([ADAPTERS[tool](spark, path, case_id) for tool, path in inputs.items()])


COMMIT_SCHEMA = (
    "batch string, replaces array<string>, events long, rejects long, first_row long, last_row long, committed_at timestamp"
)
COMPACT_FROM = 32  # batches from which a store is compacted


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # a store that was never written is an empty store
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_commits(spark: SparkSession, store: str) -> DataFrame:
    """One row per committed batch, or more if it was written again."""
    return _read(spark, f"{store}/commits", T._parse_datatype_string(COMMIT_SCHEMA))


def live_batches(spark: SparkSession, store: str) -> list[str]:
    """Batches that count: committed, and not replaced since. Their number is kept small by :func:`compact`."""
    live: dict[str, None] = {}
    for row in read_commits(spark, store).orderBy("committed_at").select("batch", "replaces").collect():
        for name in row["replaces"] or ():
            live.pop(name, None)
        live[row["batch"]] = None
    return list(live)


def commit_batch(
    spark: SparkSession, store: str, batch: str, *, replaces: list[str] | None = None, events: int | None = None,
    rejects: int | None = None, first_row: int | None = None, last_row: int | None = None,
) -> None:
    """Make a written batch count, in place of those it ``replaces``."""
    fields = T._parse_datatype_string(COMMIT_SCHEMA).fields[:-1]
    row = spark.createDataFrame([(batch, replaces or [], events, rejects, first_row, last_row)], T.StructType(fields))
    row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{store}/commits")


def read_events(spark: SparkSession, store: str, *, without_batch: str | None = None) -> DataFrame:
    """The committed events; empty before the first import. One batch can be left out."""
    rows = _read(spark, f"{store}/events", EVENT_SCHEMA)
    if "batch" in rows.columns:
        rows = rows.filter(F.col("batch").isin([name for name in live_batches(spark, store) if name != without_batch]))
    return rows.select(*EVENT_SCHEMA.names)


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """The import ledger; empty before the first import."""
    return _read(spark, f"{store}/imports", LEDGER_SCHEMA)


def missing_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose uid is not stored yet, one row per uid."""
    unique = first_by_uid(events)
    return unique.join(stored.select("event_uid"), "event_uid", "left_anti")


def stored_alike(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The part of the store that can hold the uids of ``events``.

    A uid is a hash of case, tool and time among others, so only the cases and
    tools of the batch (partition folders) and its time range (file statistics)
    are read.
    """
    row = events.agg(
        F.collect_set("case_id").alias("cases"), F.collect_set("source_tool").alias("tools"),
        F.min("event_ts").alias("low"), F.max("event_ts").alias("high"),
    ).first()
    if row["low"] is None:
        return stored.limit(0)
    return stored.filter(
        F.col("case_id").isin(row["cases"]) & F.col("source_tool").isin(row["tools"])
        & F.col("event_ts").between(F.lit(row["low"]), F.lit(row["high"]))
    )


REJECT_SCHEMA = "source_file string, source_row long, event_uid string, value string, reason string"
UNREADABLE_TIME = "unreadable time"


def untimed_rejects(events: DataFrame) -> DataFrame:
    """Reject rows of events whose time cannot be read."""
    return events.select(
        F.col("provenance.parser_output").alias("source_file"), F.col("provenance.source_row").alias("source_row"),
        "event_uid", F.col("timestamp").alias("value"), F.lit(UNREADABLE_TIME).alias("reason"),
    )


def write_rejects(rejects: DataFrame, store: str, batch: str) -> None:
    """Keep the rejected rows of one batch beside the store."""
    rejects.write.mode("overwrite").parquet(f"{store}/rejects/batch={batch}")


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    """All rejected rows of committed batches; empty before the first reject."""
    rows = _read(spark, f"{store}/rejects", T._parse_datatype_string(REJECT_SCHEMA))
    if "batch" in rows.columns:
        rows = rows.filter(F.col("batch").isin(live_batches(spark, store)))
    return rows.select("source_file", "source_row", "event_uid", "value", "reason")


def compact(spark: SparkSession, store: str, *, least_batches: int = COMPACT_FROM, file_bytes: int = 128 << 20) -> str | None:
    """Rewrite all batches as one, in files of about ``file_bytes``, if there are ``least_batches``; its name.

    Rows are ranged by case, tool and time, so a large case fills many files and a small one shares a task. The
    new batch replaces the others with its commit; a run that ends before leaves the store as it was.
    """
    live = live_batches(spark, store)
    if len(live) < least_batches:
        return None
    name = f"compact-{uuid.uuid4().hex[:16]}"
    events, rejects = read_events(spark, store), read_rejects(spark, store)
    parts = max(1, -(-planned_bytes(events) // file_bytes))
    ranged = events.repartitionByRange(parts, "case_id", "source_tool", "event_ts", "event_uid")
    write_batch(ranged, store, name)
    if not rejects.isEmpty():
        write_rejects(rejects.coalesce(max(1, -(-planned_bytes(rejects) // file_bytes))), store, name)
    commit_batch(spark, store, name, replaces=live)
    return name


def first_by_uid(events: DataFrame) -> DataFrame:
    """One row per uid; the lowest source row wins."""
    return first_by(events, ["event_uid"], ["provenance.source_row", "timestamp"]).select(*events.columns)


def write_batch(events: DataFrame, store: str, batch: str) -> None:
    """Write one batch, sorted by partition and time for skipping."""
    (
        events.sortWithinPartitions("case_id", "source_tool", "event_ts")
        .write.mode("overwrite")
        .partitionBy("case_id", "source_tool")
        .parquet(f"{store}/events/batch={batch}")
    )


def checked(events: DataFrame, case_id: str, tool: str | None = None, start_row: int | None = None) -> DataFrame:
    """Fail on blank keys or times, another case or tool, or rows below the
    resume point. One aggregate decides."""
    wrong_tool = F.lit(False) if tool is None else F.col("source_tool") != tool
    early = F.lit(False) if start_row is None else F.col("provenance.source_row") < start_row
    row = events.agg(
        F.count_if(F.coalesce("event_uid", F.lit("")) == "").alias("blank_uid"),
        F.count_if(F.coalesce("timestamp", F.lit("")) == "").alias("blank_time"),
        F.count_if(F.col("case_id") != case_id).alias("wrong_case"),
        F.count_if(wrong_tool).alias("wrong_tool"),
        F.count_if(F.col("provenance").isNull()).alias("no_provenance"),
        F.count_if(early).alias("early_row"),
    ).first()
    broken = {k: v for k, v in row.asDict().items() if v}
    if broken:
        raise InvalidEvents(f"import rules broken: {broken}")
    return events


def last_import(ledger: DataFrame, import_id: str):
    """Newest ledger row of an import, or None."""
    return ledger.filter(F.col("import_id") == import_id).orderBy(F.desc("updated_at"), F.desc("last_source_row")).first()


def source_fingerprint(spark: SparkSession, path: str) -> dict:
    """Size and content digest of one source file, of the same kind at every size.

    Lines are cut at line feeds alone, so carriage returns count as content. The
    hash of every numbered line is summed over the splits; the digest is the
    hash of that sum and the size, which also tells a last line feed.
    """
    size = list_files(spark, path).agg(F.sum("length")).first()[0]
    lines = number_records(spark.read.option("lineSep", "\n").text(path), 1)
    head = F.substring(F.sha2(F.concat_ws("|", F.col("source_row").cast("string"), "value"), 256), 1, 15)
    total = F.coalesce(F.sum(F.conv(head, 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    digest = lines.agg(F.sha2(F.concat_ws("|", F.lit(str(size)), total), 256).alias("digest")).first()["digest"]
    return {"sha256": digest, "length": size}


def import_source(
    spark: SparkSession, store: str, case_id: str, tool: str, path: str, *, max_rows: int | None = None
) -> dict:
    """Import one parser output, resuming after the last imported record.

    A changed source or a finished import is refused. ``max_rows`` bounds the
    source rows and leaves the import PARTIAL. Returns a summary whose parsed
    events are the inserted, the duplicates and the rejected ones; rejected rows
    (events without a readable time, and malformed lines, counted apart) are
    written beside the store. A run goes on after the last record of the one before,
    whether that was stored or rejected.
    """
    source = source_fingerprint(spark, path)
    ledger = read_ledger(spark, store)
    import_id = spark.range(1).select(F.sha2(F.lit(f"{case_id}|{tool}|{path}"), 256)).first()[0]
    previous = last_import(ledger, import_id)
    start_row = None
    if previous is not None:
        if previous["source_sha256"] != source["sha256"] or previous["source_size"] != source["length"]:
            raise ImportRefused("import source changed since the last run")
        if previous["status"] == COMPLETED and max_rows is None:
            raise ImportRefused(f"{tool} import is already completed")
        if previous["last_source_row"] is not None:
            start_row = previous["last_source_row"] + 1
    first = 1 if tool == "hayabusa" else 2
    max_row = None if max_rows is None else max_rows + first - 1
    events = ADAPTERS[tool](spark, path, case_id, parser_output=path, start_row=start_row, max_row=max_row)
    batch = cut_lineage(events)
    checked(batch, case_id, tool, start_row)
    good, rejected = split_unparseable(batch)
    name = f"{import_id[:16]}-{start_row or first}"
    fresh = cut_lineage(missing_events(good, stored_alike(good, read_events(spark, store, without_batch=name))))
    rejects = untimed_rejects(rejected)
    malformed, last_malformed = 0, None
    if tool == "hayabusa":
        lines = cut_lineage(limit_rows(read_detections(spark, path)[1], start_row, max_row))
        malformed, last_malformed = lines.agg(F.count(F.lit(1)), F.max("source_row")).first()
        rejects = rejects.unionByName(lines.withColumn("event_uid", F.lit(None).cast("string")))
    counts = batch.agg(F.count(F.lit(1)).alias("n"), F.max("provenance.source_row").alias("last")).first()
    inserted, refused = fresh.count(), rejected.count()
    write_batch(fresh, store, name)
    if refused + malformed:
        write_rejects(rejects, store, name)
    # The last record of all, stored or not: a line that gives no event is not read again.
    reached = [n for n in (counts["last"], last_malformed, previous["last_source_row"] if previous else None) if n is not None]
    last = max(reached, default=None)
    commit_batch(spark, store, name, events=inserted, rejects=refused + malformed, first_row=start_row or first, last_row=last)
    status = PARTIAL if max_rows is not None else COMPLETED
    row = (
        import_id, case_id, tool, path, status, source["sha256"], source["length"], last,
        max(0, last - first + 1) if last is not None else 0, inserted,
    )
    fields = LEDGER_SCHEMA.fields[:-1]
    spark.createDataFrame([row], T.StructType(fields)).withColumn("updated_at", F.current_timestamp()).write.mode(
        "append"
    ).parquet(f"{store}/imports")
    return {
        "import_id": import_id, "status": status, "inserted": inserted, "rejected": refused, "malformed": malformed,
        "duplicates": counts["n"] - refused - inserted, "last_source_row": last,
    }


def gap_fill(spark: SparkSession, store: str, case_id: str, inputs: dict[str, str | list[str]]) -> DataFrame:
    """Insert missing events of the gap-fill tools: (tool, state, existing,
    normalized, inserted, rejected). Duplicate uids inside one output are an
    error; events without a readable time are kept as rejects."""
    rows = []
    for tool in GAP_FILL_ORDER:
        stored = read_events(spark, store).filter((F.col("case_id") == case_id) & (F.col("source_tool") == tool))
        existing = stored.count()
        if not inputs.get(tool):
            rows.append((tool, NO_SOURCE, existing, 0, 0, 0))
            continue
        batch = checked(cut_lineage(ADAPTERS[tool](spark, inputs[tool], case_id)), case_id, tool)
        n, distinct = batch.agg(F.count(F.lit(1)), F.count_distinct("event_uid")).first()
        if n != distinct:
            raise InvalidEvents(f"{tool} output gives duplicate event keys")
        good, rejected = split_unparseable(batch)
        fresh = cut_lineage(missing_events(good, stored_alike(good, stored)))
        inserted, refused = fresh.count(), rejected.count()
        name = f"gap-{case_id}-{tool}-{existing}"
        if refused:
            write_rejects(untimed_rejects(rejected), store, name)
        if inserted:
            write_batch(fresh, store, name)
        if inserted or refused:
            commit_batch(spark, store, name, events=inserted, rejects=refused)
        rows.append((tool, FILLED if inserted else ALREADY, existing, n, inserted, refused))
    return spark.createDataFrame(rows, "tool string, state string, existing long, normalized long, inserted long, rejected long")
