"""Registered imports: parser outputs written from the events table, read back and stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.plans import ingest as I
from tracewright.plans import lookups as L
from tracewright.registry.base import query
from tracewright.registry.reads import EV
from tracewright.registry.views import stored_events, table
from tracewright.session import ensure_checkpoint_dir
from tracewright.sources import parsers as P
from tracewright.sources.results import write_events_jsonl
from tracewright.streaming.ingest import start_ingest, stream_events

CASE = "CASE-1"


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/imports/{uuid.uuid4().hex}"


@query(
    "scan_prefetch",
    EV + """SELECT 'APP' || CAST(u AS VARCHAR) || '.EXE' AS executable, timestamp, count(*) AS n FROM ev GROUP BY 1, 2""",
)
def scan_prefetch(spark, sf_dir):
    """Two groups of files whose headers order the same columns differently, and one lacks the optional ones."""
    base, events = _folder(spark), stored_events(spark, sf_dir)
    number = F.col("provenance.source_row")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.col("user_id").cast("string").alias("_user"))
    columns = {name: F.lit("") for name in P.REQUIRED["pecmd"]} | {
        "ExecutableName": F.concat(F.lit("APP"), F.col("_user"), F.lit(".EXE")), "LastRun": F.col("timestamp"),
    }
    rows = events.join(raw, number == F.col("_id"))
    rows.filter(number % 2 == 0).select(*[c.alias(n) for n, c in columns.items()], F.lit("x").alias("Note")).write.option(
        "header", True
    ).csv(f"{base}/a")
    rows.filter(number % 2 == 1).select(*[c.alias(n) for n, c in reversed(columns.items())]).write.option("header", True).csv(f"{base}/b")
    found = P.prefetch_events(spark, [f"{base}/a", f"{base}/b"], CASE)
    return found.groupBy("executable", "timestamp").agg(F.count(F.lit(1)).alias("n"))


@query(
    "import_rejects",
    EV + """SELECT CASE WHEN source_row % 5 = 0 THEN 'malformed JSON' WHEN source_row % 7 = 0 THEN 'unreadable time' ELSE 'stored' END AS outcome,
    count(*) AS n FROM ev WHERE source_tool = 'hayabusa' GROUP BY 1""",
)
def import_rejects(spark, sf_dir):
    """Detection lines, some cut off and some without a time: every line is stored or a reject."""
    base = _folder(spark)
    number = F.col("provenance.source_row")
    rows = stored_events(spark, sf_dir).filter(F.col("source_tool") == "hayabusa")
    time = F.when(number % 7 == 0, "no time").otherwise(F.col("timestamp"))
    line = F.to_json(F.struct(time.alias("Timestamp"), F.col("detection_rule").alias("RuleTitle"), number.cast("string").alias("RecordID")))
    cut = F.when(number % 5 == 0, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    rows.select(cut.alias("value")).coalesce(1).write.text(f"{base}/lines")
    I.import_source(spark, f"{base}/store", CASE, "hayabusa", f"{base}/lines")
    stored = I.read_events(spark, f"{base}/store").select(F.lit("stored").alias("outcome"))
    rejected = I.read_rejects(spark, f"{base}/store").select(F.col("reason").alias("outcome"))
    return stored.unionByName(rejected).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_rejects",
    EV + """SELECT CASE WHEN source_row % 5 = 0 THEN 'unreadable time' ELSE 'stored' END AS outcome, count(*) AS n FROM ev GROUP BY 1""",
)
def stream_rejects(spark, sf_dir):
    """Every fifth event has no readable time: it goes to the rejects, the others are stored."""
    base = _folder(spark)
    untimed = F.col("provenance.source_row") % 5 == 0
    events = stored_events(spark, sf_dir)
    write_events_jsonl(events.withColumn("event_ts", F.when(~untimed, F.col("event_ts"))), f"{base}/in")
    start_ingest(stream_events(spark, f"{base}/in"), f"{base}/store", f"{base}/state", once=True).awaitTermination()
    stored = I.read_events(spark, f"{base}/store").select(F.lit("stored").alias("outcome"))
    rejected = I.read_rejects(spark, f"{base}/store").select(F.col("reason").alias("outcome"))
    return stored.unionByName(rejected).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "case_scoped_reads",
    EV + """, two AS (SELECT *, 'CASE-' || CAST(source_row % 2 AS VARCHAR) AS cid FROM ev)
    SELECT 'artifact' AS read, cid, count(*) AS n FROM two WHERE artifact_type = 'mft' AND cid = 'CASE-1' GROUP BY cid
    UNION ALL SELECT 'time', cid, count(*) FROM two WHERE ts BETWEEN '2024-01-01' AND '2024-01-02' AND cid = 'CASE-1' GROUP BY cid
    UNION ALL SELECT 'log', cid, count(*) FROM two WHERE artifact_type = 'evtx' AND channel = 'Security' AND cid = 'CASE-1' GROUP BY cid""",
)
def case_scoped_reads(spark, sf_dir):
    """The filtered reads without a row limit, over one of two cases."""
    cased = F.concat(F.lit("CASE-"), (F.col("provenance.source_row") % 2).cast("string"))
    events = stored_events(spark, sf_dir).withColumn("case_id", cased)
    ids = events.select("event_uid", F.col("case_id").alias("cid"))
    reads = {
        "artifact": L.events_by_artifact(events, "mft", case_id=CASE, limit=None),
        "time": L.events_by_time(events, "2024-01-01 00:00:00", "2024-01-02 00:00:00", case_id=CASE, limit=None),
        "log": L.windows_events(events, channel="Security", case_id=CASE, limit=None),
    }
    parts = [r.select("event_uid").withColumn("read", F.lit(name)) for name, r in reads.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.join(ids, "event_uid").groupBy("read", "cid").agg(F.count(F.lit(1)).alias("n"))
