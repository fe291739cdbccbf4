import hashlib
import random

import pytest
from helpers import documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import ctph
from tracewright.llm.queries import QUERIES

M64 = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_fingerprint(text):
    codes = [0] * (ctph.WINDOW - 1) + [ord(c) for c in text]
    hashes = []
    for i in range(len(text)):
        h = 0
        for c in codes[i : i + ctph.WINDOW]:
            h = (h * 0x01000193 + c) & 0xFFFFFFFF
        hashes.append(plain_mix(h))

    def sums(level):
        out, now, is_open = [], 0, False
        for h in hashes:
            now, is_open = now + h & M64, True
            if h % (1 << level) == 0 and len(out) < ctph.MOST_CHUNKS - 1:
                out.append(now)
                now, is_open = 0, False
        return out + [now] * is_open

    symbols = ctph.SYMBOLS.tobytes().decode()
    signature = lambda level: "".join(symbols[plain_mix(s) >> 58] + symbols[plain_mix(s) >> 52 & 63] for s in sums(level))
    level = next(k for k in range(99) if len(text) <= ctph.CHUNKS << k)
    while level and len(sums(level)) < ctph.LEAST_CHUNKS:
        level -= 1
    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    levels = []
    for name in (a, b):
        size, one, two = name.split(":")
        levels.append({int(size): one, 2 * int(size): two})
    best = 0.0
    for size in levels[0].keys() & levels[1].keys():
        one, two = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (levels[0][size], levels[1][size]))
        if one and two:
            best = max(best, 2 * plain_common(one, two) / (len(one) + len(two)))
    return best


def plain_rows(docs):
    """Rows of (id, text), by id."""
    texts = [t or "" for _, t in docs]
    out = []
    for i, (name, _) in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, made, then = map(plain_fingerprint, (text, edited, after))
        out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, made, plain_likeness(own, made), plain_likeness(own, then)))
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@given(st.lists(st.text(alphabet="ab é\0😀", max_size=300), max_size=5))
@settings(max_examples=60, deadline=None)
def test_fingerprints(texts):
    assert ctph.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde fgh") for _ in range(n)) for n in (5000, 0, 40, 9000)] + ["a" * 4000, "ab" * 3000]
    whole = ctph.fingerprints(texts)
    assert whole == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(ctph, "SLICE", 700)
    assert ctph.fingerprints(texts) == whole


@given(st.lists(st.sampled_from(["AA", "AB", "BA", "BB"]), max_size=12), st.lists(st.sampled_from(["AA", "AB", "BA", "CC"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    assert ctph._common(a, b) == plain_common(a, b)


def test_likeness_follows_the_share_of_equal_text():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    for n in (10, 60, 700, 4000):
        text = words(n)
        tail, other = text[: len(text) * 3 // 4] + words(n // 4), words(n)
        moved = text[: len(text) // 3] + " inserted" + text[len(text) // 3 :]
        near, far, shifted = (ctph.likeness(*ctph.fingerprints([text, t])) for t in (tail, other, moved))
        assert 0.5 < near < 0.95 and far < 0.15 and shifted > 0.7


def test_rows_against_plain_version(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc dé\n") for _ in range(rng.choice((0, 1, 2, 30, 200, 900)))) for _ in range(60)] + [None, "", "same", "same"]
    docs = documents(spark, texts)
    want = sorted(plain_rows(list(enumerate(texts))), key=repr)
    shuffled = docs.orderBy(F.xxhash64("doc_id")).repartition(7).withColumn("text_", F.lit("clash")).withColumn("guest", F.lit(1)).withColumn("part", F.lit(2))
    assert rows(ctph.compare_with_edits(shuffled), *COLUMNS) == want
    assert rows(ctph.compare_with_edits(docs.coalesce(1), part_chars=500), *COLUMNS) == want


def test_odd_rows(spark):
    docs = documents(spark, ["abc def", None, "abc def"])
    nameless = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    found = ctph.compare_with_edits(docs.unionByName(docs).unionByName(nameless).withColumn("fingerprint", F.lit(1)))
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found.collect()) == [-1, 0, 0, 1, 1, 2, 2]
    by_text = {(r.n_chars, r.fingerprint) for r in found.collect()}
    assert len(by_text) == 2
    single = ctph.compare_with_edits(docs.limit(1)).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()
    empty = ctph.compare_with_edits(docs.limit(0))
    assert empty.columns == list(COLUMNS) and empty.count() == 0


def test_fingerprint_column(spark):
    docs = documents(spark, ["abc", None]).withColumn("fingerprint", F.lit(1))
    assert rows(ctph.with_fingerprints(docs), "doc_id", "fingerprint") == [(0, plain_fingerprint("abc")), (1, "1::")]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_table(spark, sf):
    found = QUERIES["op11_ctph"](spark, sf)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert rows(found, *COLUMNS) == sorted(plain_rows(docs), key=repr)
