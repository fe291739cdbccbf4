"""A step starts without the memory that earlier steps of its Python worker have freed but still hold."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.llm.common import BYTES_SETTING, map_arrow


def test_freed_memory_goes_back_before_another_step(spark):
    def wasteful(batches):
        held = [np.ones(4000) for _ in range(12_000)]  # 384 MB in pieces; the last one keeps the heap from shrinking
        np.kept_by_test = held[-1]
        del held
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    def measured(batches):
        for batch in batches:
            with open("/proc/self/statm") as f:
                resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
            yield pa.RecordBatch.from_arrays([pa.array([resident] * batch.num_rows, pa.int64())], ["id"])

    rows = spark.range(0, 8, 1, 8)
    assert map_arrow(rows, wasteful, "id long").count() == 8
    assert map_arrow(rows, measured, "id long").agg(F.max("id")).first()[0] < 300


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    most = map_arrow(texts, sizes, "n long").agg(F.max("n")).first()[0]
    assert spark.conf.get(BYTES_SETTING) != "67108864b" and most < 3 << 20
