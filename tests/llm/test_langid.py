import random
import zlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from tracewright.llm import langid

SYLLABLES = {
    "aa": "the ing and tion er ou wh", "bb": "der ung sch ein keit ü", "cc": "eau tion que ré è les", "dd": "ción ado ñ los ez y", "ee": "ов ст ан ая ий"
}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(words))


def table(spark, langs, rows, seed=1):
    rng = random.Random(seed)
    made = [(i, text(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(langs, k=rows))]
    return spark.createDataFrame(made, "doc_id long, text string, lang string"), made


def test_held_out_accuracy(spark):
    docs, made = table(spark, list(SYLLABLES), 400)
    model = langid.learn(docs.filter("doc_id % 2 = 0"), sample_rows=100)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in made if i % 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixed_text_is_ambiguous(spark):
    docs, _ = table(spark, ["aa", "bb"], 200)
    model = langid.learn(docs)
    rng = random.Random(4)
    parts = [text(rng, "aa", 40) + " " + text(rng, "bb", n) for n in range(5, 80)]
    _, scores, unsure = model.predict(parts)
    assert any(unsure) and not all(unsure) and min(scores) < 0.7


def test_codewords():
    for classes in (2, 3, 4, 7, 9, 30):
        codes = langid.codewords(classes)
        assert codes.shape[0] == classes and set(np.unique(codes)) <= {-1, 1}
        apart = [(a != b).sum() for i, a in enumerate(codes) for b in codes[:i]]
        assert min(apart) >= (1 if classes == 2 else 2 if classes == 3 else 4)


def test_edges(spark):
    docs, _ = table(spark, ["aa", "bb"], 60)
    model = langid.learn(docs)
    odd = documents(spark, [None, "", "12 -- !", "the " * 5]).withColumn("score", F.lit("clash")).withColumn("_score", F.lit(1))
    got = [(r.lang_pred, r.score) for r in langid.identify(odd, model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "aa"
    carried = langid.identify(odd, model, carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "_lang_pred", "_score", "_ambiguous"]
    assert carried.filter("_score > 0").count() == 1
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    one = langid.learn(docs.withColumn("lang", F.lit("xx")))
    assert [r.lang_pred for r in langid.identify(odd, one).orderBy("doc_id").collect()] == ["und", "und", "und", "xx"]
    assert langid.learn(docs.limit(0)).languages == []


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(2)
    long = text(rng, "bb", 400)
    whole = langid.features(long)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert float(whole @ langid.features(long)) > 0.99


def test_query_on_table(spark):
    from tracewright.llm.queries import op2_language

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op2_language(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_a_fit_needs_little_memory():
    """Of the whole sample a fit holds the kernel, its inverse and what the solver copies, no more."""
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 1200
    vectors = rng.random((n, langid.BUCKETS), np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = ["de", "en", "fr"] * (n // 3)
    tracemalloc.start()
    langid.fit(vectors, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.2 * n * n * 8
