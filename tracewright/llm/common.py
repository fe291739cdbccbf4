"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tracewright.operators.skew import top_n

WHITE = re.compile(rb"[\x20\x09-\x0D]")
BATCH_ROWS = 2000  # rows of an Arrow batch: texts are long, and a batch is held several times over
BATCH_BYTES = 2 << 20  # bytes of an Arrow batch, from which it is sent with fewer rows
ROWS = 256  # rows turned into Python objects at a time
CHUNK = 1 << 20  # bytes or characters of one text worked on at a time


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever the driver was started; once per application.

    The session's Arrow batches are made smaller as well, where that setting is untouched.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        if spark.conf.get(BYTES_SETTING) == "67108864b":
            spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


ENCODER = "tracewright.llm.packing"


def release_encoder() -> None:
    """Drop the word ids that an earlier task of this Python worker has kept, if one has."""
    loaded = sys.modules.get(ENCODER)
    if loaded is not None and loaded.encoder.cache_info().currsize:
        loaded.encoder.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


_step: list[str] = []


def begin_step(step: str) -> None:
    """At a worker's first task of another step, give the system back what earlier steps have freed."""
    if _step == [step]:
        return
    _step[:] = [step]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str, *, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` for functions of this package.

    Workers run the tasks of many steps, each of which starts without the memory that others have freed but still hold.
    What the encoder keeps stays for the tasks that encode; the others release it first.
    """
    ship_package(df.sparkSession)
    step = uuid.uuid4().hex

    def task(batches):
        if not encodes:
            release_encoder()
        begin_step(step)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def arrow_schema(spark_schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(spark_schema))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Column lists of at most ROWS rows, so one Arrow batch is never all Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield [column.slice(start, ROWS).to_pylist() for column in batch.columns]


def map_columns(df: DataFrame, schema: str, work: Callable[[list[list]], list[list]]) -> DataFrame:
    """Apply ``work`` (column lists in, column lists out) to slices of every partition."""

    target = arrow_schema(schema)

    def run(batches):
        for columns in rows_of(batches):
            out = work(columns)
            if len(out[0]):
                arrays = [pa.array(values, field.type) for values, field in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return map_arrow(df, run, schema)


def with_results(df: DataFrame, inputs: list, schema: str, work: Callable, carry: bool, keep: list[str]) -> DataFrame:
    """Columns that ``work`` makes of every row's ``inputs`` columns, beside ``keep`` columns or, with ``carry``, beside all.

    ``work`` takes and returns column lists. Carried columns pass through as they
    are, so no join brings them back; there the new columns' names get a leading
    underscore, and columns of ``df`` with such a name are left out.
    """
    made = _parse_datatype_string(schema).fields
    names = [f"_{f.name}" if carry else f.name for f in made]
    kept = [c for c in df.columns if c not in names] if carry else keep
    full = ", ".join(
        [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]
        + [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, made, strict=True)]
    )
    target = arrow_schema(full)
    # An input that is carried anyway is not sent twice.
    places = [kept.index(c) if isinstance(c, str) and c in kept else None for c in inputs]
    sent = [c for c, at in zip(inputs, places, strict=True) if at is None]
    places = [len(kept) + sent.index(c) if at is None else at for c, at in zip(inputs, places, strict=True)]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out = work([part.column(at).to_pylist() for at in places])
                arrays = [c.cast(f.type) for c, f in zip(part.columns[: len(kept)], target, strict=False)]
                arrays += [pa.array(values, f.type) for values, f in zip(out, list(target)[len(kept) :], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    columns = [F.col(f"`{c}`") for c in kept] + [F.col(f"`{c}`").alias(f"_input{i}") for i, c in enumerate(sent)]
    return map_arrow(df.select(*columns), run, full)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_sample(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """At most ``n`` different ids of every value of ``by`` (few values), those with the smallest hash.

    A group's size tells below which hash about four times as many rows lie; only
    those are ranked, so no task gets more than a few times ``n`` rows of a group.
    """
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    near = df.join(F.broadcast(sizes), by).filter(place * F.col("_size") <= 4 * n).select(by, id_col).distinct()
    return top_n(near, [by], [F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), F.col(id_col)], n)


def byte_words(data: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """White-space separated words of ``data``, in lists of about ``chunk`` bytes."""
    start = 0
    while start < len(data):
        end = start + chunk
        if end < len(data):
            found = WHITE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end
