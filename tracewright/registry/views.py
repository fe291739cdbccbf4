"""Evidence-shaped views over the driver's tables, in Spark and in SQL.

Each view is a projection of a whole table, so every query that reads it grows
with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.times import format_ts
from tracewright.schema import conform
from tracewright.session import cut_lineage, prepare

CASE = "DEMO"

# Table event type -> tool and artifact type; log event ids;
# severity spellings.
TOOLS = {
    "click": ("evtxecmd", "evtx"),
    "error": ("hayabusa", "hayabusa_detection"),
    "view": ("mftecmd", "mft"),
    "purchase": ("pecmd", "prefetch"),
    "signup": ("lecmd", "lnk"),
}
EVENT_IDS = [
    "4624", "4625", "4648", "4672", "4688", "4697", "4698", "4720", "4728", "4732", "4740", "7045",
]
SPELLINGS = ["info", "low", "medium", "high", "crit", "odd"]


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input with fewer splits than cores.

    Only inputs below cores x split size are shuffled by this; large inputs
    have more splits than cores and pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, *, parallel: bool = False) -> DataFrame:
    """One driver table; timestamps without zone become UTC timestamps.
    ``parallel`` spreads a small file for compute-heavy plans."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    if parallel:
        df = spread(df)
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def events_view(spark: SparkSession, sf_dir: str, *, parallel: bool = False) -> DataFrame:
    """The events table as canonical evidence events."""
    raw = table(spark, sf_dir, "events", parallel=parallel)
    kind = F.col("event_type")
    tool = F.lit(None).cast("string")
    artifact = F.lit(None).cast("string")
    for name, (tool_name, artifact_name) in TOOLS.items():
        tool = F.when(kind == name, tool_name).otherwise(tool)
        artifact = F.when(kind == name, artifact_name).otherwise(artifact)
    base = raw.select(
        "event_id",
        F.col("ts").alias("event_ts"),
        format_ts(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.upper("event_type").alias("kind"),
        tool.alias("source_tool"),
        artifact.alias("artifact_type"),
    )
    u = F.col("u").cast("string")
    is_tool = {name: F.col("source_tool") == name for name, _ in TOOLS.values()}
    log = is_tool["evtxecmd"] | is_tool["hayabusa"]
    channel = F.when(F.col("u") % 2 == 0, "Security").otherwise("System")

    def text(*cases: tuple[Column, Column]) -> Column:
        out = F.lit("")
        for condition, value in cases:
            out = F.when(condition, value).otherwise(out)
        return out

    target = F.concat(F.lit("C:/Users/user"), u, F.lit("/Downloads/app"), u, F.lit(".exe"))
    mft_path = F.when(
        F.col("k") % 2 == 0,
        F.concat(F.lit("C:\\Windows\\Prefetch\\APP"), u, F.lit(".EXE-0000ABCD.pf")),
    ).otherwise(F.concat(F.lit("C:\\Users\\user"), u, F.lit("\\Downloads\\app"), u, F.lit(".exe")))
    attrs = F.map_filter(
        F.create_map(
            F.lit("k"), F.col("k").cast("string"),
            F.lit("record_number"), F.when(is_tool["evtxecmd"], u),
            F.lit("executable_info"),
            F.when(is_tool["evtxecmd"], F.concat(F.lit("C:\\svc\\app"), u, F.lit(".exe"))),
            F.lit("record_id"), F.when(is_tool["hayabusa"], u),
            F.lit("evtx_file"), F.when(is_tool["hayabusa"], F.lit("Security.evtx")),
            F.lit("prefetch_hash"), F.when(is_tool["pecmd"], F.concat(F.lit("H"), u)),
            F.lit("run_count"), F.when(is_tool["pecmd"], F.col("k").cast("string")),
            F.lit("run_timestamp_field"),
            F.when(
                is_tool["pecmd"],
                F.when(F.col("k") % 3 != 0, "LastRun").otherwise("PreviousRun0"),
            ),
        ),
        lambda _, v: v.isNotNull(),
    )
    identity = F.concat_ws(
        "|", F.lit(CASE), "source_tool", F.lit("events"), F.col("event_id").cast("string"),
        F.lit("EVENT_TIME"), "timestamp", "kind",
    )
    return conform(
        base.select(
            F.sha2(identity, 256).alias("event_uid"),
            F.lit("1.0").alias("schema_version"),
            F.lit(CASE).alias("case_id"),
            "timestamp",
            F.lit("EVENT_TIME").alias("timestamp_type"),
            text(
                (is_tool["lecmd"], F.when(F.col("k") % 2 == 0, "LNK.SourceCreated").otherwise("LNK.TargetCreated")),
                (is_tool["mftecmd"], F.lit("MFT.Created0x10")),
                (is_tool["pecmd"], F.lit("Prefetch.LastRun")),
                (is_tool["evtxecmd"], F.lit("EVTX.TimeCreated")),
                (is_tool["hayabusa"], F.lit("Hayabusa.Timestamp")),
            ).alias("timestamp_source"),
            "artifact_type",
            F.col("kind").alias("event_type"),
            "source_tool",
            F.concat(F.lit("HOST-"), (F.col("event_id") % 3).cast("string")).alias("hostname"),
            F.when(is_tool["lecmd"], "").otherwise(F.concat(F.lit("user"), u)).alias("username"),
            text((is_tool["pecmd"], F.concat(F.lit("APP"), u, F.lit(".EXE")))).alias("executable"),
            text(
                (is_tool["mftecmd"], mft_path),
                (
                    is_tool["lecmd"],
                    F.concat(
                        F.lit("C:\\Users\\user"), u, F.lit("\\Desktop\\l"),
                        F.col("event_id").cast("string"), F.lit(".lnk"),
                    ),
                ),
            ).alias("path"),
            text((is_tool["lecmd"], target)).alias("target_path"),
            text((log, _pick(EVENT_IDS, F.col("u") % 12))).alias("windows_event_id"),
            text((is_tool["evtxecmd"], F.concat(F.lit("Provider-"), (F.col("u") % 4).cast("string")))).alias("provider"),
            text((log, channel)).alias("channel"),
            text((is_tool["hayabusa"], F.concat(F.lit("Rule "), (F.col("k") % 20).cast("string")))).alias("detection_rule"),
            text((is_tool["hayabusa"], _pick(SPELLINGS, F.col("k") % 6))).alias("severity"),
            F.concat(F.lit("event of "), "source_tool").alias("description"),
            "event_ts",
            attrs.alias("attributes"),
            F.struct(
                F.col("source_tool").alias("parser"),
                F.lit("events").alias("parser_output"),
                text(
                    (is_tool["evtxecmd"], F.concat(F.lit("C:\\logs\\"), channel, F.lit(".evtx"))),
                ).alias("source_evidence"),
                F.col("event_id").alias("source_row"),
            ).alias("provenance"),
        )
    )


# The same view for the SQL side. Attributes are separate columns a_*.
EV_CTE = r"""
raw AS (
  SELECT event_id, ts, user_id AS u, CAST(props->>'k' AS BIGINT) AS k,
         upper(event_type) AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
         CASE event_type WHEN 'click' THEN 'evtxecmd' WHEN 'error' THEN 'hayabusa'
              WHEN 'view' THEN 'mftecmd' WHEN 'purchase' THEN 'pecmd' ELSE 'lecmd' END AS source_tool
  FROM events),
ev AS (
  SELECT sha256(concat_ws('|', 'DEMO', source_tool, 'events', CAST(event_id AS VARCHAR), 'EVENT_TIME', timestamp, kind)) AS event_uid,
    'DEMO' AS case_id, timestamp, ts, epoch_us(ts) AS us, kind AS event_type, source_tool, event_id AS source_row, u, k,
    CASE source_tool WHEN 'evtxecmd' THEN 'evtx' WHEN 'hayabusa' THEN 'hayabusa_detection'
         WHEN 'mftecmd' THEN 'mft' WHEN 'pecmd' THEN 'prefetch' ELSE 'lnk' END AS artifact_type,
    CASE source_tool WHEN 'evtxecmd' THEN 'EVTX' WHEN 'hayabusa' THEN 'EVTX'
         WHEN 'mftecmd' THEN 'MFT' WHEN 'pecmd' THEN 'PREFETCH' ELSE 'LNK' END AS family,
    CASE source_tool WHEN 'lecmd' THEN CASE WHEN k % 2 = 0 THEN 'LNK.SourceCreated' ELSE 'LNK.TargetCreated' END
         WHEN 'mftecmd' THEN 'MFT.Created0x10' WHEN 'pecmd' THEN 'Prefetch.LastRun'
         WHEN 'evtxecmd' THEN 'EVTX.TimeCreated' ELSE 'Hayabusa.Timestamp' END AS timestamp_source,
    'HOST-' || CAST(event_id % 3 AS VARCHAR) AS hostname,
    CASE WHEN source_tool = 'lecmd' THEN '' ELSE 'user' || CAST(u AS VARCHAR) END AS username,
    CASE WHEN source_tool = 'pecmd' THEN 'APP' || CAST(u AS VARCHAR) || '.EXE' ELSE '' END AS executable,
    CASE WHEN source_tool = 'mftecmd' THEN
           CASE WHEN k % 2 = 0 THEN 'C:\Windows\Prefetch\APP' || CAST(u AS VARCHAR) || '.EXE-0000ABCD.pf'
                ELSE 'C:\Users\user' || CAST(u AS VARCHAR) || '\Downloads\app' || CAST(u AS VARCHAR) || '.exe' END
         WHEN source_tool = 'lecmd' THEN 'C:\Users\user' || CAST(u AS VARCHAR) || '\Desktop\l' || CAST(event_id AS VARCHAR) || '.lnk'
         ELSE '' END AS path,
    CASE WHEN source_tool = 'lecmd' THEN 'C:/Users/user' || CAST(u AS VARCHAR) || '/Downloads/app' || CAST(u AS VARCHAR) || '.exe' ELSE '' END AS target_path,
    CASE WHEN source_tool IN ('evtxecmd','hayabusa') THEN
      (['4624','4625','4648','4672','4688','4697','4698','4720','4728','4732','4740','7045'])[CAST(u % 12 + 1 AS INTEGER)] ELSE '' END AS windows_event_id,
    CASE WHEN source_tool = 'evtxecmd' THEN 'Provider-' || CAST(u % 4 AS VARCHAR) ELSE '' END AS provider,
    CASE WHEN source_tool IN ('evtxecmd','hayabusa') THEN CASE WHEN u % 2 = 0 THEN 'Security' ELSE 'System' END ELSE '' END AS channel,
    CASE WHEN source_tool = 'hayabusa' THEN 'Rule ' || CAST(k % 20 AS VARCHAR) ELSE '' END AS detection_rule,
    CASE WHEN source_tool = 'hayabusa' THEN (['info','low','medium','high','crit','odd'])[CAST(k % 6 + 1 AS INTEGER)] ELSE '' END AS severity,
    'event of ' || source_tool AS description
  FROM raw)
"""


_STAGES: dict[tuple[str, str, str], object] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build):
    """Written stage tables that several queries of one application share."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events view as a written table, as an importer would leave it."""
    return staged(spark, sf_dir, "events", lambda: cut_lineage(events_view(spark, sf_dir, parallel=True)))
