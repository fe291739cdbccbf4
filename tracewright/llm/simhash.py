"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, byte_words, map_arrow, map_columns
from tracewright.operators.components import connected_components
from tracewright.session import cut_lineage

WIDTH = 4  # words of a shingle
DISTANCE = 4  # differing bits of a link
SEED = 42
LEAST_BLOCKS = 7
CANDIDATES = 16  # chance candidates of a fingerprint that are worth saving another block
BUCKET_ROWS = 1 << 16  # a larger bucket is cut again by its remaining bits
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles of ``text``, repeats included.

    A-Z are lower-cased; a text with fewer words is one shingle; null, or no
    word, gives zero. Memory is bounded by one chunk of words for any length.
    """
    ones, total, carry = np.zeros((8, 8), np.int64), 0, []
    for words in byte_words((text or b"").lower()):
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
            octets = hashes.view(np.uint8).reshape(-1, 8)
            for k in range(8):
                ones[k] += np.bincount(octets[:, k], minlength=256) @ BITS
            total += len(hashes)
        carry = words[-(width - 1) :] if width > 1 else []
    if not total and carry:
        value = xxhash.xxh64_intdigest(b" ".join(carry), seed)
    else:
        value = sum(1 << i for i, n in enumerate(ones.ravel().tolist()) if 2 * n > total)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fingerprint long) of every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(
        docs.select(F.col(id_col), F.col(text_col).cast("binary")),
        f"`{id_col}` {kind}, fingerprint long",
        lambda columns: [columns[0], [fingerprint(t, width) for t in columns[1]]],
    )


def _masks(free: list[int], blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` among ``blocks`` equal parts of the bits ``free``.

    Two fingerprints that differ in at most ``distance`` of these bits agree
    under at least one of the masks.
    """
    parts = [sum(1 << b for b in free[i::blocks]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_count(distinct: int, distance: int = DISTANCE, bits: int = 64) -> int:
    """Fewest blocks at which a random fingerprint meets few others by chance.

    Any count above ``distance`` finds every pair; more blocks make narrower
    buckets and more copies of each fingerprint, so the count follows the
    number of distinct fingerprints.
    """
    blocks = max(LEAST_BLOCKS, distance + 1)
    while blocks < 16:
        tables = len(list(combinations(range(blocks), distance)))
        if tables * distinct / 2 ** (bits * (blocks - distance) // blocks) <= CANDIDATES:
            break
        blocks += 1
    return blocks


def _near(values: np.ndarray, x, distance: int) -> np.ndarray:
    return np.bitwise_count(values ^ x) <= distance


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect the members of a bucket exactly as all its close pairs would.

    A search over the close pairs: members already reached are not looked at
    again, so a dense bucket costs about one look per member.
    """
    out, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(left, x, distance)
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(batches, target: pa.Schema, distance: int, limit: int | None):
    """Close pairs within runs of equal (mask, key); members of runs over ``limit`` are handed on.

    Rows come sorted by (mask, key). Output rows are links (a, b, null) or
    members (a, null, mask) of a bucket to be cut again.
    """
    state = {"key": None, "held": [], "rows": 0, "hot": False}

    def close(out):
        if state["hot"] or state["rows"] < 2:
            return
        members = np.concatenate(state["held"]).view(np.uint64)
        out[0] += _forest(members, distance)

    for batch in batches:
        if not batch.num_rows:
            continue
        mask, key, value = (c.to_numpy() for c in batch.columns)
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(key)]
        out = [[], []]
        lengths = ends - starts
        inner = np.ones(len(starts), bool)
        inner[[0, -1]] = False  # the first and last run may go on in another batch
        twos = starts[inner & (lengths == 2)]
        a, b = value[twos].view(np.uint64), value[twos + 1].view(np.uint64)
        close_by = np.bitwise_count(a ^ b) <= distance
        out[0] += list(zip(a[close_by].tolist(), b[close_by].tolist(), strict=True))
        for i in np.flatnonzero(~inner | (lengths > 2)):
            run = value[starts[i] : ends[i]]
            if (mask[starts[i]], key[starts[i]]) != state["key"]:
                close(out)
                state.update(key=(mask[starts[i]], key[starts[i]]), held=[], rows=0, hot=False)
            state["held"].append(run)
            state["rows"] += len(run)
            if limit and state["rows"] > limit:
                state["hot"] = True
                members = np.concatenate(state["held"])
                out[1] += [(int(v), int(mask[starts[i]])) for v in members]
                state["held"] = []
        yield from _rows(out, target)
    out = [[], []]
    close(out)
    yield from _rows(out, target)


def _rows(out, target):
    links, members = out
    if links or members:
        a = np.array([x for x, _ in links], np.uint64).view(np.int64)
        b = np.array([y for _, y in links], np.uint64).view(np.int64)
        first = pa.concat_arrays([pa.array(a, pa.int64()), pa.array([v for v, _ in members], pa.int64())])
        second = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(members), pa.int64())])
        third = pa.concat_arrays([pa.nulls(len(links), pa.int32()), pa.array([m for _, m in members], pa.int32())])
        yield pa.RecordBatch.from_arrays([first, second, third], schema=target)


def _bucket_links(keyed: DataFrame, distance: int, limit: int | None) -> DataFrame:
    ordered = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    schema = "a long, b long, mask int"
    target = arrow_schema(schema)
    return map_arrow(
        ordered.select("mask", "key", "fingerprint"), lambda batches: _links(batches, target, distance, limit), schema
    )


def close_links(
    values: DataFrame, distance: int = DISTANCE, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(a, b) links that connect distinct ``values.fingerprint`` exactly as all close pairs do.

    Fingerprints are joined on every choice of ``blocks - distance`` blocks and
    verified by Hamming distance. A bucket of more than ``bucket_rows``
    fingerprints is cut again by its remaining bits in the same way, which
    leaves at most 2**22 values to one bucket, however many documents there are.
    No bucket writes more links than it has members.
    """
    blocks = blocks or block_count(values.count(), distance)
    masks = _masks(list(range(64)), blocks, distance)
    literal = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = values.select("fingerprint", F.posexplode(literal).alias("mask", "bits")).select(
        "mask", F.col("fingerprint").bitwiseAND(F.col("bits")).alias("key"), "fingerprint"
    )
    found = cut_lineage(_bucket_links(keyed, distance, bucket_rows))
    links = found.filter("mask is null").select("a", "b")
    if found.filter("mask is not null").isEmpty():
        return links
    deeper = [
        F.array(*[F.lit(_signed(m | n)) for n in _masks([b for b in range(64) if not m >> b & 1], LEAST_BLOCKS, distance)])
        for m in masks
    ]
    width = len(list(combinations(range(LEAST_BLOCKS), distance)))
    hot = found.filter("mask is not null").select("mask", F.col("a").alias("fingerprint"))
    again = hot.select(
        "fingerprint", F.col("mask").alias("outer"), F.posexplode(F.array(*deeper)[F.col("mask")]).alias("inner", "bits")
    ).select(
        (F.col("outer") * width + F.col("inner")).cast("int").alias("mask"),
        F.col("fingerprint").bitwiseAND(F.col("bits")).alias("key"),
        "fingerprint",
    )
    return links.unionByName(_bucket_links(again, distance, None).select("a", "b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = WIDTH,
    distance: int = DISTANCE,
    blocks: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(id, fingerprint long, component) per row of ``docs``.

    ``component`` is the smallest id that can be reached over links of at most
    ``distance`` differing bits, the row's own id included. Null text counts as
    empty; empty texts share fingerprint zero and are linked like any others.
    Repeated rows and ids stay as they are. Rows with a null id keep their
    fingerprint and take the component of their group (null if it has no id).
    Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width))
    lowest = prints.groupBy("fingerprint").agg(F.min(id_col).alias("low"))
    links = close_links(lowest.select("fingerprint"), distance, blocks, bucket_rows)
    classes = cut_lineage(connected_components(links, "a", "b"))
    joined = classes.select(F.col("node").alias("fingerprint"), F.col("component").alias("class"))
    of_class = joined.join(lowest, "fingerprint").groupBy("class").agg(F.min("low").alias("class_low"))
    labels = (
        lowest.join(joined.join(of_class, "class").select("fingerprint", "class_low"), "fingerprint", "left")
        .select("fingerprint", F.coalesce("class_low", "low").alias("component"))
    )
    return prints.join(labels, "fingerprint").select(id_col, "fingerprint", "component")


def hex_digits(column) -> Column:
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
