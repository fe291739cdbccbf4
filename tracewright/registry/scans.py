"""Registered scans: parser outputs with quoted line breaks, written from the events table and read back record by record."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.plans import acquisition as A
from tracewright.plans import ingest as I
from tracewright.registry.base import query
from tracewright.registry.reads import EV
from tracewright.registry.views import staged, stored_events, table
from tracewright.session import ensure_checkpoint_dir
from tracewright.sources import parsers as P

CASE = "CASE-1"
FILES = 16  # a file holds the events of one remainder, in their order


def _written(spark, sf_dir, tool, columns):
    """Folder of CSV files, one per remainder of the event number; other required columns are empty."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scans/{uuid.uuid4().hex}/{tool}"
    every = {name: F.lit("") for name in P.REQUIRED[tool]} | columns
    number = F.col("provenance.source_row")
    rows = stored_events(spark, sf_dir).select(
        (number % FILES).alias("_file"), number.alias("_n"), *[c.cast("string").alias(name) for name, c in every.items()]
    )
    ordered = rows.repartition(FILES, "_file").sortWithinPartitions("_file", "_n").drop("_n")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.partitionBy("_file").options(**options).csv(folder)
    return folder


def _inputs(spark, sf_dir, tools):
    return {tool: staged(spark, sf_dir, f"csv_{tool}", lambda tool=tool: _written(spark, sf_dir, tool, _columns(tool))) for tool in tools}


def _columns(tool):
    number = F.col("provenance.source_row")
    time, user = F.col("timestamp"), F.regexp_extract("event_uid", "^.{4}", 0)
    even = number % 2 == 0
    lines = F.concat(F.lit('first, of event\nsecond "quoted"\n\n'), number.cast("string"))
    return {
        "mftecmd": {
            "EntryNumber": number, "ParentPath": F.lit(".\\a\nb"), "FileName": F.concat(F.lit("f"), number.cast("string")),
            "Created0x10": time, "LastModified0x30": F.when(even, time).otherwise(" "),
        },
        "evtxecmd": {
            "TimeCreated": F.when(number % 7 == 0, "").otherwise(time), "EventId": number % 50, "Payload": lines, "UserName": user,
            "PayloadData2": F.when(even, lines),
        },
        "recmd": {
            "LastWriteTimestamp": F.when(number % 5 == 0, " ").otherwise(time), "HiveType": F.lit("SYSTEM"), "KeyPath": F.concat(F.lit("k\\"), user),
            "ValueData": lines,
        },
        "lecmd": {
            "SourceFile": F.concat(F.lit("s"), number.cast("string"), F.lit(".lnk")), "SourceCreated": F.when(even, time), "TargetAccessed": time,
            "LocalPath": F.when(even, lines), "RelativePath": F.lit("..\\r"),
        },
    }[tool]


def scan(spark, sf_dir, tool):
    folder = _inputs(spark, sf_dir, [tool])[tool]
    events = P.ADAPTERS[tool](spark, folder, CASE)
    file = F.regexp_extract("provenance.parser_output", r"_file=([0-9]+)/", 1).cast("long")
    return events.withColumn("file", file).withColumn("source_row", F.col("provenance.source_row"))


# The events with the file and record number they are written to.
ROWS = EV + """, r AS (SELECT *, source_row AS e, source_row % 16 AS file, 1 + row_number() OVER (PARTITION BY source_row % 16 ORDER BY source_row) AS record,
  'first, of event' || chr(10) || 'second "quoted"' || chr(10) || chr(10) || CAST(source_row AS VARCHAR) AS lines FROM ev)"""


@query(
    "scan_mft",
    ROWS + """SELECT file, record AS source_row, 'FILE_CREATED' AS event_type, 'MFT.Created0x10' AS timestamp_source, timestamp, CAST(e AS VARCHAR) AS mft_entry,
      '.\\a' || chr(10) || 'b\\f' || CAST(e AS VARCHAR) AS path FROM r
    UNION ALL SELECT file, record, 'FILE_MODIFIED', 'MFT.LastModified0x30', timestamp, CAST(e AS VARCHAR), '.\\a' || chr(10) || 'b\\f' || CAST(e AS VARCHAR)
    FROM r WHERE e % 2 = 0""",
)
def scan_mft(spark, sf_dir):
    return scan(spark, sf_dir, "mftecmd").select("file", "source_row", "event_type", "timestamp_source", "timestamp", "mft_entry", "path")


@query(
    "scan_log",
    ROWS + """SELECT file, record AS source_row, timestamp, CAST(e % 50 AS VARCHAR) AS windows_event_id, left(event_uid, 4) AS username, lines AS payload,
      CASE WHEN e % 2 = 0 THEN lines END AS data, 'Windows Event ID ' || CAST(e % 50 AS VARCHAR) AS description FROM r WHERE e % 7 <> 0""",
)
def scan_log(spark, sf_dir):
    rows = scan(spark, sf_dir, "evtxecmd")
    data = F.get_json_object(F.col("attributes")["payload_data"], "$.PayloadData2")
    return rows.select(
        "file", "source_row", "timestamp", "windows_event_id", "username", F.col("attributes")["payload"].alias("payload"), data.alias("data"), "description"
    )


@query(
    "scan_registry",
    ROWS + """SELECT file, record AS source_row, timestamp, 'SYSTEM' AS registry_hive, 'k\\' || left(event_uid, 4) AS registry_key, lines AS registry_value_data
    FROM r WHERE e % 5 <> 0""",
)
def scan_registry(spark, sf_dir):
    return scan(spark, sf_dir, "recmd").select("file", "source_row", "timestamp", "registry_hive", "registry_key", "registry_value_data")


@query(
    "scan_shortcut",
    ROWS + """SELECT file, record AS source_row, 'TARGET_ACCESSED' AS event_type, timestamp, 's' || CAST(e AS VARCHAR) || '.lnk' AS path,
      CASE WHEN e % 2 = 0 THEN lines ELSE '..\\r' END AS target_path FROM r
    UNION ALL SELECT file, record, 'LNK_CREATED', timestamp, 's' || CAST(e AS VARCHAR) || '.lnk', lines FROM r WHERE e % 2 = 0""",
)
def scan_shortcut(spark, sf_dir):
    return scan(spark, sf_dir, "lecmd").select("file", "source_row", "event_type", "timestamp", "path", "target_path")


@query(
    "adapter_union",
    EV + """SELECT 'mftecmd' AS source_tool, 'mft' AS artifact_type, count(*) + count(*) FILTER (source_row % 2 = 0) AS n, min(timestamp) AS first FROM ev
    UNION ALL SELECT 'evtxecmd', 'evtx', count(*) FILTER (source_row % 7 <> 0), min(timestamp) FILTER (source_row % 7 <> 0) FROM ev
    UNION ALL SELECT 'recmd', 'registry', count(*) FILTER (source_row % 5 <> 0), min(timestamp) FILTER (source_row % 5 <> 0) FROM ev
    UNION ALL SELECT 'lecmd', 'lnk', count(*) + count(*) FILTER (source_row % 2 = 0), min(timestamp) FROM ev""",
)
def adapter_union(spark, sf_dir):
    """Four tools' outputs as one event table; every event has a key of its own."""
    events = I.normalize(spark, _inputs(spark, sf_dir, ("mftecmd", "evtxecmd", "recmd", "lecmd")), CASE)
    # The first of a uid is told by whole rows, which the planner cannot narrow: only what is counted goes in.
    row = F.struct("provenance.source_row").alias("provenance")
    events = I.first_by_uid(events.select("event_uid", "source_tool", "artifact_type", "timestamp", row))
    return events.groupBy("source_tool", "artifact_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


@query(
    "gap_fill",
    EV + """, c AS (SELECT count(*) FILTER (source_row % 5 <> 0) AS reg, count(*) + count(*) FILTER (source_row % 2 = 0) AS lnk FROM ev)
    SELECT 1 AS run, 'recmd' AS tool, 'COMPLETED_MISSING_EVENTS' AS state, 0 AS existing, reg AS normalized, reg AS inserted, 0 AS rejected FROM c
    UNION ALL SELECT 1, 'lecmd', 'COMPLETED_MISSING_EVENTS', 0, lnk, lnk, 0 FROM c UNION ALL SELECT 1, 'hayabusa', 'SKIPPED_NO_SOURCE', 0, 0, 0, 0
    UNION ALL SELECT 2, 'recmd', 'ALREADY_COMPLETE', reg, reg, 0, 0 FROM c UNION ALL SELECT 2, 'lecmd', 'ALREADY_COMPLETE', lnk, lnk, 0, 0 FROM c
    UNION ALL SELECT 2, 'hayabusa', 'SKIPPED_NO_SOURCE', 0, 0, 0, 0""",
)
def gap_fill(spark, sf_dir):
    """Two tools' outputs fill an empty store; a second run finds everything there."""
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scans/{uuid.uuid4().hex}/store"
    inputs = _inputs(spark, sf_dir, ("recmd", "lecmd"))
    runs = [I.gap_fill(spark, store, CASE, inputs).withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1])


@query(
    "listing_scan",
    r"""SELECT CASE WHEN page_id % 3 = 0 THEN 'd/d' ELSE 'r/r' END AS entry_type, page_id % 2 = 1 AS deleted, CAST(page_id AS VARCHAR) || '-128-1' AS metadata_address,
      trim(url) AS path FROM pages WHERE trim(url) <> ''""",
)
def listing_scan(spark, sf_dir):
    """A listing of every page's address as a file system tool prints it, with lines of another form between."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scans/{uuid.uuid4().hex}/listing"
    number = F.col("page_id")
    kind = F.when(number % 3 == 0, "d/d ").otherwise("r/r ")
    line = F.concat(kind, F.when(number % 2 == 1, "* ").otherwise(""), number.cast("string"), F.lit("-128-1:\t"), "url")
    pages = table(spark, sf_dir, "pages").filter(F.trim("url") != "")
    pages.select(F.explode(F.array(line, F.lit("noise"), F.lit(""))).alias("value")).write.text(folder)
    return A.read_listing(spark, folder, "v").select("entry_type", "deleted", "metadata_address", "path")
