"""Live phase progress from growing log folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.plans.progress import case_progress, line_progress
from tracewright.session import cut_lineage

LINE_COLUMNS = ["case_id", "file", "position", "line", "detected", "phase_index", "phase", "percent", "started"]
LINE_SCHEMA = (
    "case_id string, file string, position long, line string, detected int, phase_index int, phase string, percent double, started boolean, batch long"
)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files below ``path``/<case>/, with the place they come from."""
    place = F.col("_metadata")
    return spark.readStream.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract(place["file_path"], r"([^/]+)/[^/]+$", 1).alias("case_id"),
        F.col("value").alias("line"),
        place["file_modification_time"].alias("written"), place["file_path"].alias("file"), place["file_block_start"].alias("start"),
    )


def stream_shared_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files that many cases share: JSON lines of ``case_id`` and ``line``, with the place they come from.

    The files are rolled by name, so their names alone order them. There are as many files as the writers make, however many
    cases there are, and a case may go on from one file to the next. What is no such JSON stays as a line of no case.
    """
    place, read = F.col("_metadata"), F.from_json("value", "case_id string, line string")
    odd = read["case_id"].isNull() & read["line"].isNull()
    return spark.readStream.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(
        read["case_id"].alias("case_id"), F.when(odd, F.col("value")).otherwise(read["line"]).alias("line"),
        F.lit(None).cast("timestamp").alias("written"), place["file_path"].alias("file"), place["file_block_start"].alias("start"),
    )


def write_shared_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """(case_id, line) as files of :func:`stream_shared_lines`, in ``order`` within a file and from file to file."""
    row = F.to_json(F.struct("case_id", "line")).alias("value")
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.select(row).write.text(path)  # part files are named by the number of their range


def start_progress(lines: DataFrame, name: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Keep one progress row per case in an in-memory table, for a look at few cases."""
    writer = (
        case_progress(lines).writeStream.format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).outputMode("complete")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_progress(spark: SparkSession, table: str) -> DataFrame:
    """Progress per line that :func:`start_line_progress` has written; empty before the first batch."""
    try:
        return spark.read.schema(LINE_SCHEMA).parquet(f"{table}/lines")
    except Exception as error:  # a table that was never written is an empty table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LINE_SCHEMA)


def _append_lines(batch: DataFrame, batch_id: int, table: str) -> None:
    """Progress of one batch's lines, after what earlier batches reached. A batch that runs again replaces its own rows."""
    spark = batch.sparkSession
    earlier = read_progress(spark, table).filter(F.col("batch") < batch_id)
    reached = earlier.groupBy("case_id").agg(F.max("phase_index").alias("reached"))
    # Tasks number the lines of a split in its order.
    numbered = cut_lineage(batch.withColumn("id", F.monotonically_increasing_id()))
    firsts = numbered.groupBy("file", "start").agg(F.min("id").alias("low"))
    placed = numbered.join(firsts, ["file", "start"]).withColumn("position", F.col("id") - F.col("low"))
    rows = line_progress(placed, ["written", "file", "start", "position"], carried=reached)
    rows.select(*LINE_COLUMNS).write.mode("overwrite").parquet(f"{table}/lines/batch={batch_id}")


def start_line_progress(lines: DataFrame, table: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append one progress row per line of :func:`stream_lines` or :func:`stream_shared_lines` to a parquet table.

    Lines of one batch come in the order of their files' times and names, then as they stand. What a case has
    reached is read from the table, so it goes on after a restart and a case may have any number of lines; no state is kept per case.
    """
    writer = (
        lines.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
        .foreachBatch(lambda batch, batch_id: _append_lines(batch, batch_id, table))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
