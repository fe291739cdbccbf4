"""JSON result documents and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of a folder, one per file, keyed by finding.

    The index file and documents that cannot be parsed are left out; the
    finding id may stand at the top or inside ``analysis``. The first file in
    name order wins.
    """
    raw = (
        spark.read.schema(schema)
        .option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("source_path", F.col("_metadata.file_path"))
        .filter(~F.col("source_path").rlike(r"/index\.json$"))
    )
    top = F.col("finding_id") if "finding_id" in raw.columns else F.lit(None).cast("string")
    nested = F.lit(None).cast("string")
    if "analysis" in raw.columns:
        nested = F.col("analysis.finding_id")
    keyed = raw.withColumn("finding_id", F.coalesce(F.nullif(top, F.lit("")), nested)).filter(
        F.col("finding_id").isNotNull()
    )
    rest = [c for c in keyed.columns if c != "finding_id"]
    return (
        keyed.groupBy("finding_id")
        .agg(F.min_by(F.struct(*rest), "source_path").alias("r"))
        .select("finding_id", "r.*")
    )


def write_events_jsonl(events: DataFrame, path: str, *, compression: str | None = None) -> None:
    """Normalized events as JSON lines, compressed if ``compression`` names how; an existing output is an error."""
    events.write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression=compression)


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """A result table as parquet; an existing output is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
