"""What the line join moves: blocks of entries and slices of counts, and no search for scripts that a text does not hold."""

import re

import numpy as np
import pyarrow as pa
from test_linededup import corpus

from tracewright.llm import linededup
from tracewright.llm.common import arrow_schema


class Ranks:
    value = np.full(1 << 8, 9, np.uint8)


def test_texts_without_unspaced_scripts_are_not_searched(monkeypatch):
    texts = ["naïve façade – “déjà vu”\n" * 3, "a中文字b ไทย é\nñ 漢", "🙂 x ﬁ 豈", "é漢\x00字é"]
    plain = [linededup.UNSPACED.sub(linededup._pairs_of, t.encode()) for t in texts]
    assert [linededup.spaced(t.encode()) for t in texts] == plain
    broken = b"\xe4\xb8 \xe4\xb8\xad\xe0\x80\xe6\x96\x87\xff\xf0\xa0\x80\x80"
    assert linededup.spaced(broken) == linededup.UNSPACED.sub(linededup._pairs_of, broken)
    monkeypatch.setattr(linededup, "UNSPACED", re.compile(rb"(?=never)(?!never)"))
    monkeypatch.setattr(linededup, "_pairs_of", None)
    assert linededup.spaced("é ñ “x”".encode()) == "é ñ “x”".encode()


def test_blocks_hold_all_entries_and_are_few(spark):
    texts = [t for t in corpus(3) if t is not None]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts])], ["doc", "text"])
    entry = arrow_schema(linededup.ENTRY)
    entries = pa.Table.from_batches(linededup._entries([batch], entry, Ranks, 0.8, 1)).to_pylist()
    blocks = list(linededup._blocks(linededup._entries([batch], entry, Ranks, 0.8, 1), arrow_schema(linededup.BLOCK), 4))
    got, buckets = [], []
    for bucket, rows, data in (row.values() for b in blocks for row in b.to_pylist()):
        columns = linededup._unpacked(rows, data)
        assert ((columns[0].view(np.uint64) >> np.uint64(60)) == bucket).all()
        got += zip(*[c.tolist() for c in columns], strict=True)
        buckets.append(bucket)
    assert sorted(got) == sorted(tuple(e.values()) for e in entries)
    assert len(buckets) == len(set(buckets)) <= 16 < len(entries)


def test_counts_of_all_tasks_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLICE_BITS", 4)
    shape = arrow_schema("doc long, line int, a long, b long, slice int, counts binary")
    batches = [pa.record_batch([pa.array([i], pa.int64()), pa.array([t])], ["doc", "text"]) for i, t in enumerate([b"a b a c", b"a d\ne"])]
    made = [r for b in batches for out in linededup._profile([b], shape, 1, 8) for r in out.to_pylist() if r["slice"] is not None]
    sent = pa.RecordBatch.from_pylist([{"slice": r["slice"], "counts": r["counts"]} for r in made], schema=pa.schema([shape.field("slice"), shape.field("counts")]))
    found = [r for b in linededup._levels([sent], arrow_schema("slice int, level binary")) for r in b.to_pylist()]
    level = {r["slice"] * 16 + k: x for r in found for k, x in enumerate(r["level"]) if x}
    words = linededup.word_hashes(b"a b a c a d e")[0]
    slots, times = np.unique(linededup._slots(words, 8), return_counts=True)
    assert level == {int(s): int(np.ceil(np.log2(n) * 6)) for s, n in zip(slots, times, strict=True) if n > 1}


def test_frequent_tokens_are_handed_on_before_a_bucket_is_whole(spark):
    target = arrow_schema(f"{linededup.PAIR}, token long, n int, pos int, s1 long, s2 long, kind long, probe boolean")
    size = 40
    columns = [np.zeros(size, np.int64), np.arange(size), np.zeros(size, np.int32), np.full(size, 9, np.int32), np.zeros(size, np.int32)]
    columns += [np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size), np.ones(size, bool)]
    columns[0][::8] = 7  # five lines hold a token that is not frequent
    parts = [[c[at : at + 10].astype(t) for c, t in zip(columns, linededup.ENTRY_TYPES, strict=True)] for at in range(0, size, 10)]
    data = [b"".join(c.tobytes() for c in part) for part in parts]
    batch = pa.record_batch([pa.array([0] * 4, pa.int32()), pa.array([10] * 4, pa.int32()), pa.array(data, pa.binary())], ["bucket", "rows", "data"])
    rows = pa.Table.from_batches(linededup._block_candidates([batch], target, 0.8, None, 5)).to_pylist()
    assert sorted(r["x_doc"] for r in rows if r["token"] == 0) == [d for d in range(size) if d % 8]
    assert sorted((r["x_doc"], r["y_doc"]) for r in rows if r["token"] is None) == [(x, y) for x in range(0, size, 8) for y in range(0, x, 8)]
