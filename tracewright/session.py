"""Session settings and the reliable-checkpoint helper."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Stored tables hold long hex keys and repeated texts; in memory they take several times their files' size. By the files alone the
# planner would broadcast tables of over 100 MB, and send them to the driver for it.
FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
PLANNING_CONF = {
    FILE_FACTOR: "8.0",
}

DEFAULT_CONF = {
    **REQUIRED_CONF,
    **PLANNING_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app: str = "tracewright", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators rely on.

    On a cluster leave ``master`` unset: spark-submit supplies it, together
    with ``spark.checkpoint.dir`` and the shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on, and set how sizes are estimated where that is untouched, on a session made elsewhere."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in PLANNING_CONF.items():
        if float(spark.conf.get(key)) == 1.0:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a ``local[*]`` master; a cluster
    without the setting is an error, because a machine-local folder would be
    lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(configured)
    return configured


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever the driver was started; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}-functions.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))  # Spark serves it to the workers; the folder is the driver's own
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    A written table, unlike a cached one, survives lost executors; unlike an
    RDD checkpoint it keeps column pruning and size statistics, so later joins
    can be planned by the real size.
    """
    spark = df.sparkSession
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
