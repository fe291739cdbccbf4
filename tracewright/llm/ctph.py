"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, map_arrow, rows_of, with_results

WINDOW = 7  # code points of the rolling hash
CHUNKS = 64  # chunks that a text has at most on average
LEAST_CHUNKS = 16  # with fewer, smaller blocks are tried
MOST_CHUNKS = 128  # the last of them takes in all that follows
SLICE = 1 << 18  # code points hashed at a time
PART_CHARS = 1 << 24  # of a sorted part of the corpus

# The symbols of a signature, two for each chunk.
SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(text: str) -> np.ndarray:
    """Hash of the WINDOW code points that end at each code point of ``text`` but the first WINDOW - 1."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = len(codes) - WINDOW + 1
    h = codes[:size].copy()
    for i in range(1, WINDOW):
        h *= np.uint32(0x01000193)
        h += codes[i : i + size]
    return _mixed(h.astype(np.uint64))


def _slices(text: str) -> Iterator[np.ndarray]:
    """Rolling hashes of every code point of a text, SLICE at a time; before the first one stand zeros."""
    for start in range(0, len(text), SLICE):
        before = text[max(0, start - WINDOW + 1) : start]
        yield rolling(before.rjust(WINDOW - 1, "\0") + text[start : start + SLICE])


def _chunk_sums(slices: Iterable[np.ndarray], level: int) -> np.ndarray:
    """Sum of the rolling hashes of each chunk; a chunk ends where the hash is a multiple of ``2**level``."""
    mask = np.uint64((1 << level) - 1)
    found, count, total, open_end = [], 0, np.uint64(0), False
    for hashes in slices:
        sums = np.cumsum(hashes) + total
        cuts = np.flatnonzero((hashes & mask) == 0)[: MOST_CHUNKS - 1 - count]
        found.append(sums[cuts])
        count += len(cuts)
        total = sums[-1]
        open_end = not len(cuts) or cuts[-1] < len(hashes) - 1
    if open_end:
        found.append(np.array([total], np.uint64))
    ends = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return np.diff(ends, prepend=np.uint64(0))


def _signature(sums: np.ndarray) -> str:
    code = (_mixed(sums) >> np.uint64(52)).astype(np.int64)
    return SYMBOLS[np.stack([code >> 6, code & 63], axis=1).ravel()].tobytes().decode()


def _of_slices(size: int, slices: Callable[[], Iterable[np.ndarray]]) -> str:
    level = max(0, -(-size // CHUNKS) - 1).bit_length()
    sums = _chunk_sums(slices(), level)
    while level and len(sums) < LEAST_CHUNKS:
        level -= 1
        sums = _chunk_sums(slices(), level)
    return f"{1 << level}:{_signature(sums)}:{_signature(_chunk_sums(slices(), level + 1))}"


def fingerprints(texts: list[str]) -> list[str]:
    """``block size:signature:signature at twice that size`` of every text."""
    with np.errstate(over="ignore"):
        out: list[str] = []
        group: list[str] = []

        def flush() -> None:
            blank = "\0" * (WINDOW - 1)
            hashes = rolling(blank + blank.join(group)) if group else None
            at = 0
            for text in group:
                own = hashes[at : at + len(text)]
                out.append(_of_slices(len(text), lambda own=own: [own] if len(own) else []))
                at += len(text) + WINDOW - 1
            group.clear()

        held = 0
        for text in texts:
            if len(text) > SLICE:
                flush()
                held = 0
                out.append(_of_slices(len(text), lambda text=text: _slices(text)))
                continue
            if held + len(text) > SLICE:
                flush()
                held = 0
            group.append(text)
            held += len(text) + WINDOW - 1
        flush()
        return out


def _common(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, by bits."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if set(a).isdisjoint(b):
        return start + end
    places: dict[str, int] = {}
    for i, symbol in enumerate(a):
        places[symbol] = places.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        met = row & places.get(symbol, 0)
        row = (row + met | row - met) & full
    return start + end + len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over the chunks of both."""
    if not a or not b:
        return 0.0
    one, other = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 2 * _common(one, other) / (len(one) + len(other))


def likeness(a: str, b: str) -> float:
    """0 to 1: how much two fingerprints have in common at a block size that both have; 0 if there is none.

    Equal fingerprints have 1; that of an empty text has 0 to all others.
    """
    if a == b:
        return 1.0
    (size_a, *parts_a), (size_b, *parts_b) = a.split(":"), b.split(":")
    levels_a = {int(size_a) << i: part for i, part in enumerate(parts_a)}
    levels_b = {int(size_b) << i: part for i, part in enumerate(parts_b)}
    return max((_alike(levels_a[size], levels_b[size]) for size in levels_a.keys() & levels_b.keys()), default=0.0)


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` and the fingerprint of every whole text (null: as of an empty text); an earlier ``out_col`` column is replaced."""

    def work(columns: list[list]) -> list[list]:
        return [fingerprints([text or "" for text in columns[0]])]

    found = with_results(docs.drop(out_col), [text_col], "made string", work, True, [])
    return found.withColumnRenamed("_made", out_col)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _order(absent: bool, name, digest: int) -> tuple:
    return (absent, 0 if absent else name, digest)


def _dealt(batches, target: pa.Schema, bounds: list[tuple]):
    """Rows with the part they lie in; the first row of a part is a guest of the part before it as well."""
    for batch in batches:
        keys = [_order(*key) for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        part = [bisect_right(bounds, key) - 1 for key in keys]
        first = [i for i, key in enumerate(keys) if bounds[bisect_left(bounds, key) % len(bounds)] == key]
        for rows, parts, guest in ((batch, part, False), (batch.take(pa.array(first, pa.int64())), [(part[i] - 1) % len(bounds) for i in first], True)):
            if rows.num_rows:
                more = [pa.array(parts, pa.int32()), pa.array([guest] * rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], schema=target)


def _compared(batches, target: pa.Schema):
    """Results of the sorted rows of one part, each with the row after it; guests come last and only end it."""
    held: tuple | None = None
    for ids, texts, guests in rows_of(batches):
        texts = [text or "" for text in texts]
        rows = [*([held] if held else []), *zip(ids, texts, guests, fingerprints(texts), strict=True)]
        held = rows[-1]
        own = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
        if not own:
            continue
        halves = [len(a[1]) // 2 for a, _ in own]
        edited = [a[1][: len(a[1]) - half] + b[1][:half] for (a, b), half in zip(own, halves, strict=True)]
        prints = fingerprints(edited)
        columns = [
            [a[0] for a, _ in own], [len(a[1]) for a, _ in own], [hashlib.sha256(text.encode()).hexdigest() for text in edited],
            [a[3] for a, _ in own], prints,
            [likeness(a[3], made) for (a, _), made in zip(own, prints, strict=True)], [likeness(a[3], b[3]) for a, b in own],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per document: its fingerprint beside those of an edited text and of the next document.

    The edited text has the last half of the code points (rounded down) replaced
    by the first as many, or all, of the next document's in ascending order of
    ids; the first follows the last. Rows with one id follow each other in the order of a
    hash of their texts, rows without id come last; a null text is an empty one. A single
    document follows itself. An empty table gives an empty result. Ids of any type that
    Python orders as Spark does (numbers, dates).

    Ids are dealt to ranges of about ``part_chars`` characters whose first rows also go to the
    range before, so each text is moved once and each range is read in order by one task.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")
    )
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // part_chars))
    keys = ["absent", "id", "digest"]
    ranged = rows.select(*keys).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    # One row per range, however large the corpus.
    bounds = sorted(_order(*row.first) for row in ranged.groupBy("part").agg(F.min(F.struct(*keys)).alias("first")).collect())
    schema = f"{id_col} {id_type}, {RESULT}"
    if not bounds:
        return spark.createDataFrame([], schema)
    dealt_schema = f"absent boolean, id {id_type}, digest long, text string, part int, guest boolean"
    dealt_target, target = arrow_schema(dealt_schema), arrow_schema(schema)
    dealt = map_arrow(rows, lambda batches: _dealt(batches, dealt_target, bounds), dealt_schema)
    ordered = dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("guest", *keys).select("id", "text", "guest")
    return map_arrow(ordered, lambda batches: _compared(batches, target), schema)
