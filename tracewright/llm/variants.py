"""Spelling variants: near words by the permuterm rotations of a corpus's vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, map_arrow, rows_of
from tracewright.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = "$"  # stands in no word
LEAST_LENGTH = 6
LEAST_COUNT = 5
SLIP_EVERY = 199  # one in so many of a document's words is misspelt
RATIO = 5  # times as often as a word its form occurs at least
HELD_WORDS = 1 << 16  # counted words that a task holds
CHUNK = 1 << 20  # characters of a text searched at a time
HELD_ROWS = 1 << 16


def runs(text: str) -> Counter:
    """How often each maximal run of letters occurs, with A-Z in lower case."""
    out: Counter = Counter()
    start = 0
    while start < len(text):
        end = start + CHUNK
        while end < len(text) and RUN.match(text, end):  # so that no run is cut
            end = RUN.match(text, end).end()
        out.update(RUN.findall(text, start, end))
        start = end
    lowered: Counter = Counter()
    for run, n in out.items():
        lowered[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return lowered


def slipped(run: str, prefix: int, every: int) -> str:
    """``run``, without one code point if its checksum says so; ``prefix`` is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches, target: pa.Schema, least_length: int, every: int | None):
    """(word, n) rows of a task, several of one word where it holds too many."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=target)
        held.clear()
        return out

    for ids, texts in rows_of(batches):
        for name, text in zip(ids, texts, strict=True):
            prefix = zlib.crc32(f"{name or ''}:".encode())
            for run, n in runs(text or "").items():
                if len(run) < least_length:
                    continue
                word = slipped(run, prefix, every) if every else run
                if len(word) >= least_length:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    slip_every: int | None = None,
) -> DataFrame:
    """(word, n): the runs of letters of whole texts with ``least_length`` code points and ``least_count`` occurrences.

    With ``slip_every``, every word of a document whose checksum with the id is a multiple of it
    loses one code point first. Null texts have no words; a null id counts as an empty one.
    """
    schema = "word string, n long"
    target = arrow_schema(schema)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = map_arrow(rows, lambda batches: _counted(batches, target, least_length, slip_every), schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, apart, n): the rotations of every marked word, as prefix ranges and as themselves.

    For a word ``a + x + b`` the rotation ``b$a`` + ``x`` lies in the range of the prefix ``b$a``, which
    skips x: in it are the words with another character there, and the word ``ab`` without one, whose own
    rotation is ``b$a`` (``skipped`` is null). ``apart`` is false where x repeats the character before it:
    ``ab`` is reached by leaving out the first of a run of equal characters only.
    """
    word, size = F.col("word"), F.length("word")
    piece = lambda start, length: F.substring(word, start, length)
    rotated = lambda before, after: F.concat(piece(after, size), F.lit(END), piece(F.lit(1), before))
    ranges = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            rotated(i, i + 2).alias("key"), piece(i + 1, F.lit(1)).alias("skipped"), ((i == 0) | (piece(i, F.lit(1)) != piece(i + 1, F.lit(1)))).alias("apart")
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.struct(rotated(i, i + 1).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("apart"))
    )
    return words.select("n", F.explode(F.concat(ranges, whole)).alias("r")).select("r.key", "r.skipped", "r.apart", "n")


def _better(one: tuple | None, other: tuple | None) -> tuple | None:
    """Of two (-n, word), the more frequent, then the smaller word."""
    return min((x for x in (one, other) if x), default=None)


def group_neighbours(key: str, members: list[tuple]) -> list[tuple]:
    """(word, near words in this group, the best of them and its n) of the members (skipped, apart, n) of one range."""
    after, _, before = key.partition(END)
    whole = next(((-n, before + after) for skipped, _, n in members if skipped is None), None)
    filled = [(-n, before + skipped + after, apart) for skipped, apart, n in members if skipped is not None]
    best = sorted(x[:2] for x in filled)[:2]
    out = []
    for n, word, apart in filled:
        near = len(filled) - 1 + bool(whole and apart)
        other = next((x for x in best if x[1] != word), None)
        if near:
            out.append((word, near, _better(other, whole if apart else None)))
    if whole and (shorter := [x[:2] for x in filled if x[2]]):
        out.append((whole[1], len(shorter), min(shorter)))
    return [(word, near, top[1], -top[0]) for word, near, top in out]


def _scanned(batches, target: pa.Schema):
    """Neighbours from sorted rotations; groups of one row are passed over without being looked at."""

    def found(table: pa.Table) -> pa.RecordBatch | None:
        key = table.column("key").combine_chunks()
        same = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) if len(key) > 1 else []
        inside = np.flatnonzero(same)
        rows = np.union1d(inside, inside + 1)
        if not len(rows):
            return None
        out: list[tuple] = []
        now, members = None, []
        part = table.take(rows)
        for name, *member in zip(*(part.column(c).to_pylist() for c in ("key", "skipped", "apart", "n")), strict=True):
            if name != now:
                if members:
                    out += group_neighbours(now, members)
                now, members = name, []
            members.append(tuple(member))
        out += group_neighbours(now, members)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target) if out else None

    held: list[pa.RecordBatch] = []
    size = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < HELD_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = pc.equal(table.column("key"), table.column("key")[-1])
        split = pc.index(last, pa.scalar(True)).as_py()  # the last group may go on in the next batch
        if split and (made := found(table.slice(0, split))):
            yield made
        held = table.slice(split).to_batches()
        size = table.num_rows - split
    if held and (made := found(pa.Table.from_batches(held))):
        yield made


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words of ``words`` (word, n) differ from a word by one character inserted,
    deleted or replaced, and the most frequent of them (ties: the smallest). Words without any are left out.

    A range holds one word per letter of the alphabet and one shorter word at most, so no group is large.
    """
    schema = "word string, near long, best string, best_n long"
    target = arrow_schema(schema)
    ordered = rotations(words).repartition("key").sortWithinPartitions("key")
    found = map_arrow(ordered, lambda batches: _scanned(batches, target), schema)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", F.col("top.best").alias("near"), (-F.col("top.order")).alias("near_n")
    )


def last_of_chain(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) from each word end; chains are halved every round. No link may close a circle."""
    ends = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = cut_lineage(
            ends.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        )
        ends = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return ends


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    slip_every: int | None = None,
) -> DataFrame:
    """One row per word of :func:`vocabulary`: word, form, root, n, n_near, form_n.

    A word's ``form`` is the most frequent of its near words (ties: the smallest in code-point order), if that is
    ``ratio`` times as frequent; else null, as is ``form_n``. ``root`` is the last word on the way from form to form,
    the word itself if it has none. ``n_near`` is 0 without near words. An empty table, null and empty texts give no rows.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col, least_length=least_length, least_count=least_count, slip_every=slip_every))
    known = F.col("near_n") >= ratio * F.col("n")
    found = cut_lineage(
        words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("near")).alias("form"), F.when(known, F.col("near_n")).alias("form_n")
        )
    )
    roots = last_of_chain(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
