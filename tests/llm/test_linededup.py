import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, rows
from pyspark.sql import functions as F

from tracewright.llm import linededup


def line_sets(texts):
    return [
        (d, k, frozenset(line.encode().lower().split()))
        for d, t in enumerate(texts) if t is not None for k, line in enumerate(t.split("\n"))
    ]


def plain(texts, threshold=0.8, least=1):
    found, earlier = set(), []
    for d, k, words in line_sets(texts):
        if len(words) < max(least, 1):
            continue
        if any(10 * len(words & w) >= round(10 * threshold) * len(words | w) for w in earlier):
            found.add((d, k))
        earlier.append(words)
    return found


def corpus(seed, documents_made=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    seen, texts = [], []
    for _ in range(documents_made):
        lines = []
        for _ in range(rng.randint(0, 8)):
            if seen and rng.random() < 0.5:
                words = rng.choice(seen)[:]
                for _ in range(rng.randint(0, max(1, len(words) // 6))):
                    edit = rng.random()
                    if edit < 0.4 and words:
                        words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
                    elif edit < 0.7:
                        words.append(rng.choice(vocabulary))
                    elif words:
                        words.pop(rng.randrange(len(words)))
            else:
                words = rng.choices(vocabulary, weights, k=rng.choice([3, 6, 9, 14, 30, 60]))
            seen.append(words)
            lines.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("options", [{}, {"first_candidates": 1}, {"hot_run": 5}, {"threshold": 0.6, "least_words": 3, "first_candidates": 2, "hot_run": 4}])
def test_against_all_pairs(spark, options, monkeypatch):
    texts = corpus(len(options) + 3)
    if options:
        monkeypatch.setattr(linededup, "SLICE_BYTES", 900)
    got = rows(linededup.duplicate_lines(documents(spark, texts), **options), "doc", "line")
    want = plain(texts, options.get("threshold", 0.8), options.get("least_words", 1))
    assert set(got) == want and len(got) == len(want) > 20


def test_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"p{i}" for i in range(60)]
    texts = [" ".join(rng.sample(base, 57) + [f"u{i}"]) for i in range(200)]
    got = linededup.duplicate_lines(documents(spark, texts))
    assert {r.doc for r in got.collect()} == {d for d, _ in plain(texts)} == set(range(1, 200))


def test_short_lines(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "one one two", "one two two", "a", "A a", "b", "a b", "a b c"]
    assert set(rows(linededup.duplicate_lines(documents(spark, texts)), "doc", "line")) == plain(texts) == {(1, 0), (3, 0), (5, 0)}


def test_edges(spark):
    line = "one two three four five six"
    texts = [None, "", line, "a\n" + line.upper() + "\n\nb", "one two", "one two", line + "\n" + line, "x" * 30]
    docs = documents(spark, texts).withColumn("n_removed", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("words", F.lit(2))
    docs = docs.unionByName(docs.filter("doc_id in (2, 3)"))  # repeated rows share their place
    docs = docs.unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    got = {}
    for r in linededup.remove_duplicate_lines(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.text, r.n_lines, r.n_removed, r.line))
    assert got[None] == {(texts[3], 4, 0, 1)}
    assert got[0] == {(None, 0, 0, 1)} and got[1] == {("", 1, 0, 1)}
    assert got[2] == {(line, 1, 0, 1)} and got[3] == {("a\n\nb", 4, 1, 1)}
    assert got[4] == {("one two", 1, 0, 1)} and got[5] == {("", 1, 1, 1)}
    assert got[6] == {("", 2, 2, 1)}
    assert linededup.remove_duplicate_lines(docs.limit(0)).count() == 0


def test_slices_hash_words_and_number_lines(monkeypatch):
    texts = [t.encode() for t in corpus(5, 40)] + [b"", b"\n\n", b"one line of words " * 60 + b"\nlast", b"x" * 500 + b"\n\ny"]
    want = {(d, k): line.lower().split() for d, t in enumerate(texts) for k, line in enumerate(t.split(b"\n"))}
    names = {}
    for size in (1 << 20, 2000, 600):
        monkeypatch.setattr(linededup, "SLICE_BYTES", size)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
        got = {}
        for lines in linededup.line_slices([batch]):
            for h, i in zip(lines.words.tolist(), lines.line.tolist(), strict=True):
                got.setdefault((int(lines.doc[i]), int(lines.number[i])), []).append(h)
        assert set(got) == {k for k, w in want.items() if w}
        for place, hashes in got.items():
            for word, h in zip(want[place], hashes, strict=True):
                assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_short_sets_are_counted():
    words = np.array([1, 65, 129, 193, 257, 7, 7, 7, 7, 7, 1, 2], np.uint64)
    lines = linededup.Lines(np.arange(3), np.arange(3), words, np.repeat([0, 1, 2], [5, 5, 2]))
    assert linededup._enough(lines, 5).tolist() == [True, False, False]


def test_long_line(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLICE_BYTES", 50)
    texts = corpus(21, 25)
    assert set(rows(linededup.duplicate_lines(documents(spark, texts)), "doc", "line")) == plain(texts)


def test_query_on_table(spark):
    from tracewright.llm.queries import op5_lines

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(docs) == list(range(len(docs)))
    gone = plain([docs[i] for i in range(len(docs))])
    got = {r.doc_id: r for r in op5_lines(spark, sf).collect()}
    for i, text in docs.items():
        kept = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
        assert got[i].text == "\n".join(kept)
        assert (got[i].n_lines, got[i].n_removed) == (text.count("\n") + 1, text.count("\n") + 1 - len(kept))
