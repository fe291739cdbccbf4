"""File listings: newest inputs, run groups, capabilities, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tool order, file name patterns and excluded names.
TOOL_ORDER = ["mftecmd", "evtxecmd", "pecmd", "recmd", "lecmd", "hayabusa"]
TOOL_PATTERNS = {
    "mftecmd": r"mftecmd_.*\.csv$", "evtxecmd": r"evtxecmd_.*\.csv$", "pecmd": r"pecmd_.*\.csv$",
    "recmd": r"recmd_.*\.csv$", "lecmd": r"lecmd_.*\.csv$", "hayabusa": r"timeline_.*\.jsonl$",
}
EXCLUDED = r"(?i)^pecmd_.*_timeline\.csv$"
RUN_PREFIX = r"(?i)^(recmd_\d{8}T\d{6}Z)_"
# Collected family -> (folder, tool that reads it).
FAMILIES = {
    "mft": ("filesystem", "mftecmd"), "evtx": ("eventlogs", "evtxecmd"), "prefetch": ("prefetch", "pecmd"),
    "registry": ("registry", "recmd"), "lnk": ("lnk", "lecmd"), "amcache": ("amcache", None), "srum": ("srum", None),
    "powershell_history": ("powershell_history", None),
}
# Display family -> path fragments.
DISPLAY_FAMILIES = {
    "Event Logs": [".evtx"],
    "Registry": ["\\registry\\", "\\software", "\\system", "\\sam", "ntuser.dat", "usrclass.dat"],
    "Prefetch": [".pf"],
    "LNK": [".lnk"],
    "Jump Lists": ["automaticdestinations-ms", "customdestinations-ms"],
}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of every file below a folder; contents
    are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.regexp_replace("path", r"^file:(//)?", "").alias("path"),
            F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
            "length", F.col("modificationTime").alias("modified"),
        )
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of source files."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_replace("path", r"^file:(//)?", "").alias("path"), "length", F.sha2("content", 256).alias("sha256")
    )


def bounded_listing(files: DataFrame, *, limit: int | None = 500) -> DataFrame:
    """First files by path, each with the number of all files (``total``) and whether the listing is cut (``bounded``)."""
    total = files.count()
    rows = files.orderBy("path")
    rows = rows if limit is None else rows.limit(limit)
    cut = limit is not None and total > limit
    return rows.withColumn("total", F.lit(total).cast("long")).withColumn("bounded", F.lit(cut))


def parser_outputs(files: DataFrame) -> DataFrame:
    """Files that are a tool's output, with the tool."""
    tool = F.lit(None).cast("string")
    for name, pattern in TOOL_PATTERNS.items():
        tool = F.when(F.col("name").rlike(f"^{pattern}"), name).otherwise(tool)
    return files.withColumn("tool", tool).filter(F.col("tool").isNotNull() & ~F.col("name").rlike(EXCLUDED))


def latest_inputs(files: DataFrame) -> DataFrame:
    """The newest output per tool; for the many-file tool all files of its
    newest run."""
    outputs = parser_outputs(files)
    single = outputs.filter(F.col("tool") != "recmd").groupBy("tool").agg(
        F.max_by("path", F.struct("modified", "name")).alias("path")
    )
    runs = outputs.filter(F.col("tool") == "recmd").withColumn("run", F.regexp_extract("name", RUN_PREFIX, 1)).filter(
        F.col("run") != ""
    )
    newest = runs.agg(F.max("run").alias("run"))
    many = runs.join(F.broadcast(newest), "run", "left_semi").select("tool", "path")
    return single.unionByName(many)


def available_tools(files: DataFrame) -> DataFrame:
    """Tools with at least one output, in import order."""
    order = F.array_position(F.array(*[F.lit(t) for t in TOOL_ORDER]), F.col("tool"))
    return parser_outputs(files).groupBy("tool").agg(F.count(F.lit(1)).alias("files")).withColumn("position", order)


def capabilities(files: DataFrame) -> DataFrame:
    """State and file count of every artifact family; absent ones count zero."""
    spark = files.sparkSession
    names = spark.createDataFrame(
        [(f, folder, tool) for f, (folder, tool) in FAMILIES.items()], "family string, folder string, tool string"
    )
    counts = (
        files.withColumn("folder", F.regexp_extract("path", r"/triage/([^/]+)/", 1))
        .groupBy("folder")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return names.join(counts, "folder", "left").select(
        "family", "tool", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.coalesce("n", F.lit(0)) > 0, "AVAILABLE").otherwise("ABSENT").alias("state"),
    )


def display_families(path: Column) -> Column:
    """All display families a path belongs to."""
    low = F.lower(path)

    def holds(fragments: list[str]) -> Column:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | low.contains(fragment)
        return hit

    return F.array_compact(F.array(*[F.when(holds(f), F.lit(name)) for name, f in DISPLAY_FAMILIES.items()]))


def family_metrics(files: DataFrame) -> DataFrame:
    """(metric, n): files per display family (a file may count in several),
    all files and all bytes. One pass over the listing."""
    families = F.concat(display_families(F.col("path")), F.array(F.lit("total_files")))
    counted = files.select(F.explode(families).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).select(F.lit("total_bytes").alias("metric"), "n")
    return counted.unionByName(size)


def recent_files(files: DataFrame, n: int = 100) -> DataFrame:
    """Most recently changed files with their first display family."""
    return files.orderBy(F.desc("modified"), "path").limit(n).select(
        F.coalesce(F.get(display_families(F.col("path")), F.lit(0)), F.lit("Other")).alias("family"), "path", "length"
    )


def overall_status(results: DataFrame) -> DataFrame:
    """One status over tool results (status SUCCESS, PARTIAL_SUCCESS, FAILED)."""
    return results.agg(
        F.bool_or(F.col("status") == "FAILED").alias("_failed"),
        F.bool_or(F.col("status") == "PARTIAL_SUCCESS").alias("_partial"),
        F.count(F.lit(1)).alias("tools"),
    ).select(
        F.when(F.coalesce("_failed", F.lit(False)), "FAILED")
        .when(F.coalesce("_partial", F.lit(False)), "PARTIAL_SUCCESS")
        .otherwise("SUCCESS").alias("status"),
        "tools",
    )
