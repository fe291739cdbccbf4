"""Line deduplication by an exact set-similarity join of lines over their rarest words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WHITE, arrow_schema, fresh_name, map_arrow, map_columns, rows_of
from tracewright.session import cut_lineage

THRESHOLD = 0.8
LEAST_WORDS = 1  # lines with fewer different words are similar to none
COUNT_BITS = 22  # word counts are kept for 2**COUNT_BITS hash values, whatever the corpus; any number gives the same lines
FILTER_BITS = 25
FIRST_CANDIDATES = 32  # candidates of a line that are verified before the rest is looked at
CLOSE_CANDIDATES = 2  # of a line with close candidates, those that are verified first
HOT_RUN = 50_000  # lines with one rare word that one task compares
SLICE_BYTES = 1 << 18  # of text hashed at a time
KEPT_KEYS = 100_000  # line keys that a task remembers
SLICE_BITS = 16  # word counts move in slices of 2**SLICE_BITS hash values
BLOCK_ENTRIES = 1 << 17  # entries that a task holds before it hands them on
BUCKET_LINES = 20_000  # lines of the corpus for each bucket of words

# UTF-8 of runs of Thai, Lao, Myanmar, Khmer, kana and Han characters, which are written without blanks.
UNSPACED = re.compile(
    rb"(?:\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80\x81\x9e\x9f][\x80-\xbf]|\x82[\x80-\x9f])"
    rb"|\xe3(?:\x81|\x82|\x83|[\x90-\xbf])[\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2})+"
)
# Every such run lies in a run of these bytes, which are found faster.
HIGH = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0][\x80-\xbf\xe0\xe1\xe3-\xe9\xef\xf0]*")

ENTRY = "token long, doc long, line int, n int, pos int, s1 long, s2 long, kind long, probe boolean"
ENTRY_TYPES = ("<i8", "<i8", "<i4", "<i4", "<i4", "<i8", "<i8", "<i8", "?")
BLOCK = "bucket int, rows int, data binary"
PAIR = "x_doc long, x_line int, y_doc long, y_line int, more boolean"


@dataclass
class Lines:
    """Some lines of some documents: line i is (doc[i], number[i]); word hashes with the index of their line."""

    doc: np.ndarray
    number: np.ndarray
    words: np.ndarray
    line: np.ndarray


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``, and the places of its line ends.

    A word's hash is a polynomial of its bytes, so sums over the whole text give
    all of them at once; it depends on the word alone.
    """
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(SLICE_BYTES.bit_length() + 2, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts]), starts, np.flatnonzero(codes == 10)


def _pairs_of(match: re.Match) -> bytes:
    run = match[0].decode(errors="replace")
    return f" {' '.join(map(''.join, zip(run, run[1:], strict=False))) or run} ".encode()


def spaced(text: bytes) -> bytes:
    """``text`` with every run of a script without blanks as its overlapping pairs of characters; lines stay."""
    return text if text.isascii() else HIGH.sub(lambda run: UNSPACED.sub(_pairs_of, run[0]), text)


def _segments(batches) -> Iterator[tuple[int, int, bytes, bool]]:
    """(doc, number of the first line, text, goes on in a line begun before) of at most SLICE_BYTES and a word."""
    for names, texts in rows_of(batches):
        for name, text in zip(names, texts, strict=True):
            if name is None or text is None:
                continue
            text = spaced(text)
            at, number, goes_on = 0, 0, False
            while at < len(text):
                end = at + SLICE_BYTES
                if end < len(text):
                    cut = text.rfind(b"\n", at, end)
                    found = None if cut >= at else WHITE.search(text, end)
                    end = cut if cut >= at else found.start() if found else len(text)
                part = text[at:end]
                yield name, number, part, goes_on
                number += part.count(b"\n")
                goes_on = end < len(text) and text[end] != 10
                if not goes_on:
                    end, number = end + 1, number + 1
                at = end


def _groups(texts: tuple[bytes, ...]) -> Iterator[slice]:
    """Consecutive texts of about SLICE_BYTES together; only a line longer than that needs more than one group."""
    start = size = 0
    for i, text in enumerate(texts):
        if size >= SLICE_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    yield slice(start, len(texts))


def line_slices(batches) -> Iterator[Lines]:
    """Lines of (id, text) batches, about SLICE_BYTES at a time; documents without id are left out."""
    held, size = [], 0

    def flush() -> Lines:
        docs, numbers, texts, goes_on = zip(*held, strict=True)
        sizes = np.array([t.count(b"\n") + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(texts)), sizes)
        number = np.array(numbers)[segment] + np.arange(len(segment)) - first[segment]
        merged = np.ones(len(segment), bool)
        merged[first[np.array(goes_on)]] = False
        words, line, done = [], [], 0
        for start in _groups(texts):
            hashes, begins, breaks = word_hashes(b"\n".join(texts[start]).lower())
            words.append(hashes)
            ends = np.r_[0, np.searchsorted(begins, breaks), len(begins)]
            line.append(np.repeat(np.arange(done, done + len(breaks) + 1), np.diff(ends)))
            done += len(breaks) + 1
        words, line = np.concatenate(words), (np.cumsum(merged) - 1)[np.concatenate(line)]
        doc, number = np.array(docs, np.int64)[segment][merged], number[merged]
        used = np.flatnonzero(np.bincount(line, minlength=len(doc)))
        place = np.zeros(len(doc), np.int64)
        place[used] = np.arange(len(used))
        return Lines(doc[used], number[used].astype(np.int32), words, place[line])

    for segment in _segments(batches):
        # A slice ends before a new line, so that every line is whole.
        if size >= SLICE_BYTES and not segment[3]:
            out = flush()
            if len(out.doc):
                yield out
            held, size = [], 0
        held.append(segment)
        size += len(segment[2]) + 1
    if held:
        out = flush()
        if len(out.doc):
            yield out


def _starts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, line[1:] != line[:-1]])


def _class_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over all words of a line: equal for lines with the same words, each as often."""
    starts = _starts(lines.line)
    return np.add.reduceat(lines.words, starts), np.add.reduceat(_mixed(lines.words ^ np.uint64(0x5851F42D4C957F2D)), starts)


def _enough(lines: Lines, least: int) -> np.ndarray:
    """Which lines have ``least`` different words; the few that a sketch leaves open are counted."""
    if least <= 1:
        return np.ones(len(lines.doc), bool)
    starts = _starts(lines.line)
    sketch = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (lines.words & np.uint64(63)), starts))
    enough = sketch >= least
    ends = np.r_[starts[1:], len(lines.line)]
    for i in np.flatnonzero(~enough & (ends - starts >= least)):
        enough[i] = len(np.unique(lines.words[starts[i] : ends[i]])) >= least
    return enough


def _slots(words: np.ndarray, count_bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - count_bits)).astype(np.int64)


def _profile(batches, target: pa.Schema, least: int, count_bits: int):
    """Lines with the key of their words, then how many words fell to each hash value, in slices of hash values."""
    counts = np.zeros(1 << count_bits, np.uint32)
    for lines in line_slices(batches):
        np.add.at(counts, _slots(lines.words, count_bits), np.uint32(1))
        a, b = _class_keys(lines)
        kept = np.flatnonzero(_enough(lines, least))
        nothing = pa.nulls(len(kept), pa.int32())
        columns = [lines.doc[kept], lines.number[kept], a[kept].view(np.int64), b[kept].view(np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), nothing, pa.nulls(len(kept), pa.binary())], schema=target)
    for number in range(-(-len(counts) >> SLICE_BITS)):
        part = counts[number << SLICE_BITS : number + 1 << SLICE_BITS]
        used = np.flatnonzero(part)
        if len(used):
            data = used.astype("<u2").tobytes() + part[used].astype("<u4").tobytes()
            yield pa.RecordBatch.from_pylist([{"slice": number, "counts": data}], schema=target)


def _levels(batches, target: pa.Schema):
    """Rarity levels of the hash values of each slice, a byte each, from the counts of all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_buffer()
            size = len(data) // 6
            total = sums.setdefault(number, np.zeros(1 << SLICE_BITS, np.int64))
            total[np.frombuffer(data, "<u2", size)] += np.frombuffer(data, "<u4", size, size * 2)
    for number, total in sums.items():
        level = np.minimum(255, np.ceil(np.log2(np.maximum(total, 1)) * 6)).astype(np.uint8)
        yield pa.RecordBatch.from_pylist([{"slice": number, "level": level.tobytes()}], schema=target)


def _ranks(counts: DataFrame, count_bits: int) -> np.ndarray:
    """Level of every hash value from (slice, counts) rows: 0 for words that occur once, more for frequent ones."""
    schema = "slice int, level binary"
    target = arrow_schema(schema)
    found = map_arrow(counts.repartition("slice"), lambda batches: _levels(batches, target), schema).toArrow()
    rank = np.zeros(max(1 << count_bits, 1 << SLICE_BITS), np.uint8)
    for number, level in zip(found["slice"].to_pylist(), found["level"], strict=True):
        rank[number << SLICE_BITS : number + 1 << SLICE_BITS] = np.frombuffer(level.as_buffer(), np.uint8)
    return rank[: 1 << count_bits]


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    """Rarest words of a line of ``n`` that every similar line shares at least one of."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _sets(lines: Lines, rank: np.ndarray):
    """Different words of every line by (rank, hash): (hash, line, position, words per line, rank)."""
    ranks = rank[_slots(lines.words, len(rank).bit_length() - 1)]
    key = (lines.line.astype(np.uint64) << np.uint64(45)) | (ranks.astype(np.uint64) << np.uint64(37)) | (lines.words >> np.uint64(27))
    order = np.argsort(key)
    words, line = lines.words[order], lines.line[order]
    new = np.r_[True, (words[1:] != words[:-1]) | (line[1:] != line[:-1])]
    words, line = words[new], line[new]
    n = np.bincount(line, minlength=len(lines.doc))
    position = np.arange(len(line)) - (np.cumsum(n) - n)[line]
    return words, line, position, n, ranks[order][new]


def _entries(batches, target: pa.Schema, rank, threshold: float, least: int, places=None, tokens=None):
    """A row for every word of every line's prefix that another line may hold.

    Copies of a line that this task has seen further up in the corpus are left
    out: they are exact copies of a line that is there. ``places`` and ``tokens``
    are filters of lines and words; with ``places``, only rows that fit it are
    probes, and with ``tokens``, only rows that fit that are made.
    """
    first: dict[tuple[int, int], tuple[int, int]] = {}
    for lines in line_slices(batches):
        if tokens is not None:
            hit = np.zeros(len(lines.doc), bool)
            hit[lines.line[tokens.value.holds(lines.words)]] = True
            if not hit.any():
                continue
            kept = hit[lines.line]
            lines = Lines(lines.doc[hit], lines.number[hit], lines.words[kept], (np.cumsum(hit) - 1)[lines.line[kept]])
        words, line, position, n, ranks = _sets(lines, rank.value)
        a, b = _class_keys(lines)
        kind = _mixed(a ^ _mixed(b))
        wanted = n >= least
        probe = np.ones(len(n), bool) if places is None else places.value.holds(place_hashes(lines.doc, lines.number))
        for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if wanted[i]:
                place = (int(lines.doc[i]), int(lines.number[i]))
                if first.get(key, place) < place:
                    wanted[i] = places is not None and probe[i]
                else:
                    first[key] = place
        if len(first) > KEPT_KEYS:
            first.clear()
        # Parity of the words in each of 2 x 64 bins: lines differ in at least as many words as in bins.
        starts = _starts(line)
        bit = np.uint64(1) << (words & np.uint64(63))
        half = bit * (words >> np.uint64(6) & np.uint64(1))
        s1, s2 = np.bitwise_xor.reduceat(half, starts), np.bitwise_xor.reduceat(bit ^ half, starts)
        chosen = (position < prefix_size(n, threshold)[line]) & (ranks > 0) & wanted[line]
        if tokens is not None:
            chosen &= tokens.value.holds(words)
        elif places is not None:
            chosen &= probe[line]
        kept = np.flatnonzero(chosen)
        of = line[kept]
        columns = [
            words[kept].view(np.int64), lines.doc[of], lines.number[of], n[of].astype(np.int32), position[kept].astype(np.int32),
            s1[of].view(np.int64), s2[of].view(np.int64), kind[of].view(np.int64), probe[of],
        ]
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=target)


def _blocks(batches, target: pa.Schema, bits: int):
    """Entries in blocks: of about BLOCK_ENTRIES of a task, those of each of 2**``bits`` buckets of tokens, column after column."""
    held: list[list[np.ndarray]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        bucket = columns[0].view(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order].astype(t, copy=False) for c, t in zip(columns, ENTRY_TYPES, strict=True)], bucket[order]
        starts = _starts(bucket)
        ends = np.r_[starts[1:], len(bucket)]
        data = [b"".join(c[low:high].tobytes() for c in columns) for low, high in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], schema=target)

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= BLOCK_ENTRIES:
            yield packed()
            size = 0
    if held:
        yield packed()


def _unpacked(rows: int, data: pa.Buffer) -> list[np.ndarray]:
    out, at = [], 0
    for kind in map(np.dtype, ENTRY_TYPES):
        out.append(np.frombuffer(data, kind, rows, at))
        at += rows * kind.itemsize
    return out


def _run_pairs(entries: dict[str, np.ndarray], threshold: float, limit: int | None):
    """Candidate pairs (x later, y earlier) of runs of one token, after the length, position and parity bounds.

    Of lines with the same words only the first of a run takes part; the others
    are exact copies.

    A line gets its nearest earlier candidates: CLOSE_CANDIDATES of those whose
    parities differ in at most half the bins that similarity allows, or ``limit``
    others if it has none; ``more`` says that some were left out.
    """
    order = np.lexsort((np.arange(len(entries["token"])), entries["kind"], entries["token"]))
    token, kind = entries["token"][order], entries["kind"][order]
    kept = np.sort(order[np.r_[True, (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])]])
    x, y, more = _first_pairs({name: column[kept] for name, column in entries.items()}, threshold, limit)
    whole = np.zeros(len(order), bool)
    whole[kept] = more
    return kept[x], kept[y], whole


def _first_pairs(entries: dict[str, np.ndarray], threshold: float, limit: int | None):
    token, n, pos = entries["token"], entries["n"].astype(np.int64), entries["pos"].astype(np.int64)
    s1, s2 = entries["s1"].view(np.uint64), entries["s2"].view(np.uint64)
    starts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1]
    index = np.arange(len(token)) - np.repeat(starts, np.diff(np.r_[starts, len(token)]))
    close, far = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
    more = np.zeros(len(token), bool)
    xs, ys, near_by = [], [], []
    active = np.flatnonzero((index > 0) & entries["probe"])
    lag = 1
    while len(active):
        x, y = active, active - lag
        nx, ny = n[x], n[y]
        least = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9)
        fits = (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9) & (np.minimum(nx - pos[x], ny - pos[y]) >= least)
        x, y, least = x[fits], y[fits], least[fits]
        apart = np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[y])
        allowed = n[x] + n[y] - 2 * least
        kept = (apart <= allowed) & ((entries["doc"][x] != entries["doc"][y]) | (entries["line"][x] != entries["line"][y]))
        x, y, likely = x[kept], y[kept], 2 * apart[kept] <= allowed[kept]
        xs.append(x)
        ys.append(y)
        near_by.append(likely)
        close[x] += likely
        far[x] += ~likely
        lag += 1
        active = active[index[active] >= lag]
        if limit:
            full = (close[active] >= CLOSE_CANDIDATES) | (far[active] >= limit)
            more[active[full]] = True
            active = active[~full]
    x, y, likely = (np.concatenate(c or [np.zeros(0, np.int64)]) for c in (xs, ys, near_by))
    if limit:
        # Far candidates of a line that has close ones wait until those are verified.
        wait = ~likely.astype(bool) & (close[x] > 0)
        more[x[wait]] = True
        x, y = x[~wait], y[~wait]
    return x, y, more


def _pair_batch(columns: list[np.ndarray], target: pa.Schema, threshold: float, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole runs of sorted entries."""
    entries = dict(zip(_names(ENTRY), columns, strict=True))
    x, y, more = _run_pairs(entries, threshold, limit)
    if len(x):
        out = [entries["doc"][x], entries["line"][x], entries["doc"][y], entries["line"][y], more[x]]
        blank = [pa.nulls(len(x), f.type) for f in list(target)[5:]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), *blank], schema=target)


def _candidates(batches, target: pa.Schema, threshold: float, limit: int | None):
    """Candidate pairs of entries sorted by token, doc and line."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < HOT_RUN // 4:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        split = int(np.flatnonzero(columns[0] == columns[0][-1])[0])
        if split:
            yield from _pair_batch([c[:split] for c in columns], target, threshold, limit)
        held = [[c[split:] for c in columns]]
        rows -= split
    if held:
        yield from _pair_batch([np.concatenate(c) for c in zip(*held, strict=True)], target, threshold, limit)


def _block_candidates(batches, target: pa.Schema, threshold: float, limit: int | None, hot_run: int):
    """Candidate pairs of blocks sorted by bucket; entries of a token in over ``hot_run`` lines are handed on (y and more null)."""
    held: list[list[np.ndarray]] = []
    rows, now, hot = 0, None, np.zeros(0, np.int64)
    room = 4 * hot_run

    def handed(columns: list[np.ndarray]) -> pa.RecordBatch:
        entries = dict(zip(_names(ENTRY), columns, strict=True))
        size = len(entries["doc"])
        out = [pa.array(entries["doc"]), pa.array(entries["line"]), *(pa.nulls(size, f.type) for f in list(target)[2:5])]
        out += [pa.array(np.ascontiguousarray(entries[k])) for k in ("token", "n", "pos", "s1", "s2", "kind", "probe")]
        return pa.RecordBatch.from_arrays(out, schema=target)

    def parted() -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The entries held that are hot, and the others."""
        nonlocal hot
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        token, count = np.unique(columns[0], return_counts=True)
        hot = np.union1d(hot, token[count > hot_run])
        is_hot = np.isin(columns[0], hot) if len(hot) else np.zeros(len(columns[0]), bool)
        return [c[is_hot] for c in columns], [c[~is_hot] for c in columns] if is_hot.any() else columns

    def bucket_pairs():
        over, columns = parted()
        if len(over[0]):
            yield handed(over)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        if len(order):
            yield from _pair_batch([c[order] for c in columns], target, threshold, limit)

    for batch in batches:
        for bucket, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != now:
                if held:
                    yield from bucket_pairs()
                    held.clear()
                now, rows, hot, room = bucket, 0, hot[:0], 4 * hot_run
            held.append(_unpacked(size, data.as_buffer()))
            rows += size
            if rows > room:
                over, columns = parted()
                if len(over[0]):
                    yield handed(over)
                held.append(columns)
                rows = len(columns[0])
                room = max(room, 2 * rows)
    if held:
        yield from bucket_pairs()


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _candidate_pairs(texts: DataFrame, made, threshold: float, limit: int | None, hot_run: int, bits: int) -> DataFrame:
    """PAIR rows of the entries that ``made`` makes of batches of ``texts``.

    They move as blocks, one row for the entries of a task in a bucket. Tokens in over ``hot_run`` lines are dealt to cells
    of two parts and compared there.
    """
    schema = f"{PAIR}, token long, n int, pos int, s1 long, s2 long, kind long, probe boolean"
    target, block = arrow_schema(schema), arrow_schema(BLOCK)
    blocks = map_arrow(texts, lambda batches: _blocks(made(batches), block, bits), BLOCK)
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    found = cut_lineage(map_arrow(dealt, lambda batches: _block_candidates(batches, target, threshold, limit, hot_run), schema))
    names, pair_names = _names(ENTRY), _names(PAIR)
    pairs = found.filter("y_doc is not null").select(*pair_names)
    handed = found.filter("token is not null").withColumnsRenamed({"x_doc": "doc", "x_line": "line"}).select(*names)
    if handed.isEmpty():
        return pairs
    parts = handed.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / hot_run).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc", "line"), F.col("parts")).cast("int")
    celled = handed.join(parts, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = celled.withColumn("token", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    ordered = cells.repartition("token").sortWithinPartitions("token", "doc", "line").select(*names)
    return pairs.unionByName(map_arrow(ordered, lambda batches: _candidates(batches, target, threshold, limit), schema).select(*pair_names))


class HashFilter:
    """Which of 2**FILTER_BITS hash values occur: the same size for any input, with chance hits and no misses."""

    def __init__(self, hashes: DataFrame):
        """``hashes``: one column of longs."""
        spot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - FILTER_BITS)
        words = hashes.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits")
        ).toArrow()
        self.bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        self.bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits[spot >> 5] >> (spot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def place_hashes(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(_mixed(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))


def _place_filter(places: DataFrame) -> HashFilter:
    """Filter of (doc, line) rows."""

    def work(columns: list[list]) -> list[list]:
        return [place_hashes(np.array(columns[0], np.int64), np.array(columns[1], np.int64)).view(np.int64)]

    return HashFilter(map_columns(places.select("doc", "line"), "hash long", work))


def _word_sets(docs: DataFrame, needed) -> DataFrame:
    """(doc, line, words) of the lines that ``needed`` may name."""

    def work(columns: list[list]) -> list[list]:
        out = [[], [], []]
        rows = [(name, text) for name, text in zip(*columns, strict=True) if name is not None and text is not None]
        sizes = np.array([text.count(b"\n") + 1 for _, text in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        line = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        chosen = np.flatnonzero(needed.value.holds(place_hashes(np.array([name for name, _ in rows], np.int64)[row], line)))
        at, lines = None, []
        for i, k in zip(row[chosen].tolist(), line[chosen].tolist(), strict=True):
            if i != at:
                at, lines = i, rows[i][1].split(b"\n")
            out[0].append(rows[i][0])
            out[1].append(k)
            out[2].append([w.decode() for w in dict.fromkeys(spaced(lines[k]).lower().split())])
        return out

    return map_columns(docs, "doc long, line int, words array<string>", work)


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` with the truth of their Jaccard similarity."""
    spark = docs.sparkSession
    places = pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).unionByName(
        pairs.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line"))
    )
    bits = spark.sparkContext.broadcast(_place_filter(places))
    sets = cut_lineage(_word_sets(docs, bits).dropDuplicates(["doc", "line"]))
    for side in "xy":
        named = sets.select(F.col("doc").alias(f"{side}_doc"), F.col("line").alias(f"{side}_line"), F.col("words").alias(f"{side}_words"))
        pairs = pairs.join(named, [f"{side}_doc", f"{side}_line"])
    shared = F.size(F.array_intersect("x_words", "y_words"))
    union = F.size("x_words") + F.size("y_words") - shared
    return pairs.select("x_doc", "x_line", "y_doc", "y_line", "more", (shared >= F.lit(threshold) * union - 1e-9).alias("similar"))


def duplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    threshold: float = THRESHOLD,
    least_words: int = LEAST_WORDS,
    copied_words: int | None = None,
    first_candidates: int = FIRST_CANDIDATES,
    hot_run: int = HOT_RUN,
    count_bits: int = COUNT_BITS,
) -> DataFrame:
    """(doc, line): lines (numbered from 0) whose word set has Jaccard similarity ``threshold`` to that of an earlier line.

    Earlier means a smaller (id, line number) anywhere in ``docs``, whether that
    line goes or stays. Words are split at white space, with A-Z lower-cased;
    runs of Han, kana, Thai, Lao, Khmer and Myanmar characters count as their
    overlapping pairs of characters. Lines with fewer than ``least_words``
    different words are similar to none; exact copies (the same words, each as
    often) of lines of ``copied_words`` different words go as well, by default of
    as many. Lines of null texts and ids take no part. Ids are integers; rows that
    repeat an id are one document to this operator, as their lines share places.

    Exact copies meet by the key of their word set. Others meet on the rarest
    words of a line, as many as similarity demands; counts over the whole corpus
    order words by rarity, and a word that occurs once meets nothing. Length,
    position and parity bounds leave few candidates; these are verified by
    their words. A line is done with when one of its first candidates (a few close ones,
    or ``first_candidates`` others) is similar; lines with further candidates and
    none similar have all of them verified.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    copied = least_words if copied_words is None else min(copied_words, least_words)
    schema = "doc long, line int, a long, b long, slice int, counts binary"
    shape = arrow_schema(schema)
    profile = cut_lineage(map_arrow(texts, lambda batches: _profile(batches, shape, copied, count_bits), schema))
    keyed = profile.filter("slice is null").select("doc", "line", "a", "b")
    firsts = keyed.groupBy("a", "b").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("copies"))
    copies = keyed.join(firsts.filter("copies > 1"), ["a", "b"]).filter(F.struct("doc", "line") > F.col("first")).select("doc", "line")

    ranks = spark.sparkContext.broadcast(_ranks(profile.filter("slice is not null").select("slice", "counts"), count_bits))
    target = arrow_schema(ENTRY)
    bits = min(16, max(4, (keyed.count() // BUCKET_LINES).bit_length()))

    def entries(batches):
        return _entries(batches, target, ranks, threshold, least_words)

    pairs = _candidate_pairs(texts, entries, threshold, first_candidates, hot_run, bits)
    pairs = pairs.groupBy("x_doc", "x_line", "y_doc", "y_line").agg(F.max("more").alias("more"))
    checked = cut_lineage(_verified(pairs, texts, threshold))
    near = checked.filter("similar").select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line"))
    state = checked.groupBy("x_doc", "x_line").agg(F.max("similar").alias("similar"), F.max("more").alias("more"))
    open_lines = cut_lineage(
        state.filter("more and not similar").select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line"))
    )
    if not open_lines.isEmpty():
        at = spark.sparkContext.broadcast(_place_filter(open_lines))
        asking = texts.join(open_lines.select("doc").distinct(), "doc", "left_semi").select("doc", "text")
        asked = map_arrow(asking, lambda batches: _entries(batches, target, ranks, threshold, least_words, at), ENTRY)
        words = spark.sparkContext.broadcast(HashFilter(asked.select("token").distinct()))

        def rest(batches):
            return _entries(batches, target, ranks, threshold, least_words, at, words)

        further = _candidate_pairs(texts, rest, threshold, None, hot_run, bits).drop("more").distinct().withColumn("more", F.lit(False))
        again = _verified(further, texts, threshold).filter("similar")
        near = near.unionByName(again.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")))
    return copies.unionByName(near).distinct()


def remove_duplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    lines_col: str = "n_lines",
    removed_col: str = "n_removed",
    **options,
) -> DataFrame:
    """``docs`` with the lines of :func:`duplicate_lines` taken out of the text, and how many it had and lost.

    Null texts stay null and have no lines. Rows keep their other columns, save
    that earlier ``lines_col`` and ``removed_col`` columns are replaced. A document
    may be left with an empty text.
    """
    place, gone = fresh_name(docs, "_doc"), fresh_name(docs, "_gone")
    found = duplicate_lines(docs, id_col, text_col, **options)
    by_doc = found.groupBy(F.col("doc").alias(place)).agg(F.collect_set("line").alias(gone))
    joined = docs.drop(lines_col, removed_col).join(by_doc, F.col(id_col).cast("long") == F.col(place), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    missing = F.coalesce(gone, F.array().cast("array<int>"))
    kept = F.filter(lines, lambda _, i: ~F.array_contains(missing, i))
    return (
        joined.withColumn(lines_col, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn(removed_col, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop(place, gone)
    )
