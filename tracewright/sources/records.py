"""Records of quoted text files whose fields hold line breaks, without reading a file in one task.

A record border is a line end with an even number of quotes before it. Every split counts its quotes and, for
either state at its start, the records that begin in it; sums over the splits, one row each, then tell every
split in which state it starts and which record is its first. With that, splits are read on their own; a record
over a split border comes in pieces, which are joined by file and number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tracewright.session import ship_package

QUOTE = '"'
PROFILE = "file string, start long, quotes long, outside long, inside long"
PIECE = "file string, number long, start long, value string"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    place = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(paths).select(
        place["file_path"].alias("file"), place["file_block_start"].alias("start"), F.make_valid_utf8("value").alias("value")
    )


def _runs(batches) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start of the split, lines) of consecutive lines of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value = batch.columns
        edges = [0, batch.num_rows]
        if batch.num_rows > 1:
            other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
            edges[1:1] = (np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()
        for low, high in zip(edges, edges[1:], strict=False):
            yield file[low].as_py(), start[low].as_py(), value[low:high]


def _states(lines: pa.Array, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, state after, blank) of every line; state 1 is inside a quoted field."""
    quotes = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
    after = (np.cumsum(quotes) + state) & 1
    blank = pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r")).to_numpy(zero_copy_only=False)
    return np.r_[state, after[:-1]], after, blank


def _profile(batches, target: pa.Schema):
    """One row per split: parity of its quotes, and the records that begin in it if it starts outside or inside a field."""
    found: dict[tuple[str, int], list[int]] = {}
    for file, start, lines in _runs(batches):
        row = found.setdefault((file, start), [0, 0, 0])
        before, after, blank = _states(lines, row[0])
        row[0] = int(after[-1])
        row[1] += int(((before == 0) & ~blank).sum())
        row[2] += int(((before == 1) & ~blank).sum())
    if found:
        columns = [[k[0] for k in found], [k[1] for k in found], *map(list, zip(*found.values(), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def split_states(profile: list) -> tuple[dict[tuple[str, int], tuple[int, int]], bool]:
    """(state at its start, number of the first record that begins in it) of every split, from rows of all splits;
    whether any split ends within a field."""
    out, file, open_end = {}, None, False
    for row in sorted(profile, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, state, number = row["file"], 0, 1
        out[file, row["start"]] = (state, number)
        number += row["inside"] if state else row["outside"]
        state ^= row["quotes"]
        open_end |= bool(state)
    return out, open_end


def _records(batches, target: pa.Schema, states, whole: bool):
    """The records that lie in one split, or the pieces of those that don't."""
    plan = states.value
    now, state, number = None, 0, 0
    held: list[str] = []  # lines of the open record
    headless = False  # it began in an earlier split
    out: list[tuple] = []

    def close(complete: bool) -> None:
        if held and (complete and not headless) == whole:
            out.append((now[0], number, now[1], "\n".join(held)))
        held.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    for file, start, lines in _runs(batches):
        if (file, start) != now:
            close(False)
            now = (file, start)
            state, first = plan[now]
            number, headless = first - 1, bool(state)
        before, after, blank = _states(lines, state)
        begins = (before == 0) & ~blank
        numbers = number + np.cumsum(begins)
        single = np.flatnonzero(begins & (after == 0))
        if whole and len(single):
            rows = [pa.array([file] * len(single)), pa.array(numbers[single]), pa.array([start] * len(single)), lines.take(pa.array(single))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows, target, strict=True)], schema=target)
        for i in np.flatnonzero((before == 1) | (begins & (after == 1))).tolist():
            if begins[i]:
                number, headless = int(numbers[i]), False
            held.append(lines[i].as_py())
            if not after[i]:
                close(True)
        number, state = int(numbers[-1]), int(after[-1])
        if out:
            yield batch_of(out)
            out.clear()
    close(False)
    if out:
        yield batch_of(out)


def quoted_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, number, value): every record of quoted text files, numbered from 1 per file in file order.

    Quotes within fields are doubled; a quote in an unquoted field counts as an opening one. Empty lines between records are
    no records; line breaks in fields stay as they are. A field that is never closed reaches to the end of its file. An empty file has no record.
    Huge files are read by many tasks, twice, and a third time where records cross split borders; the driver holds one row per split.
    """
    ship_package(spark)
    lines = _lines(spark, paths)
    profile_target, target = (to_arrow_schema(_parse_datatype_string(s)) for s in (PROFILE, PIECE))
    plan, open_end = split_states(lines.mapInArrow(lambda batches: _profile(batches, profile_target), PROFILE).collect())
    states = spark.sparkContext.broadcast(plan)
    found = lines.mapInArrow(lambda batches: _records(batches, target, states, True), PIECE).select("file", "number", "value")
    if open_end:
        pieces = lines.mapInArrow(lambda batches: _records(batches, target, states, False), PIECE)
        joined = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        found = found.unionByName(joined.select("file", "number", F.array_join(F.col("parts")["value"], "\n").alias("value")))
    return found.withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\ufeff", ""))
