import hashlib
import random
import re

from helpers import documents
from pyspark.sql import functions as F

from tracewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    words = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        w = words_of(item)
        windows = [w] if 0 < len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)]
        for x in windows:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_random_texts(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(30)]
    items += [(50 + i, " ".join(rng.choice("xyzé") for _ in range(rng.randint(4, 30)))) for i in range(40)]
    texts = [" ".join(rng.choice("abcdxyzéq") for _ in range(40)) for _ in range(20)]
    for _ in range(80):
        part = words_of(rng.choice(items[30:])[1])
        a = rng.randint(0, max(0, len(part) - 5))
        texts.append("q Q " + ", ".join(part[a : a + rng.randint(3, 20)]) + "! " + rng.choice("xyz"))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 4):
        for shard in (10**6, 60):
            got = {
                r.doc_id: (r.n_words, r.n_hit, list(r["items"]))
                for r in decontaminate.contamination(docs, bench, window=window, shard_words=shard).collect()
            }
            assert got == {i: plain(t, items, window) for i, t in enumerate(texts)}


def test_cleaned_text_and_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", "keep this. " + item.upper() + " and that", item, "one two three four five six seven eight nine", "--"]
    docs = documents(spark, texts).withColumn("items", F.lit(1)).withColumn("drop", F.lit("x"))
    bench = spark.createDataFrame([(3, item), (4, None), (None, "--"), (3, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, with_text=True).collect()}
    assert got[0].n_words == 0 and got[0].cleaned is None and not got[0].drop
    assert got[1].cleaned == "" and got[5].n_words == 0
    assert got[2].cleaned == "keep this.  and that" and got[2].n_hit == 11 and not got[2].drop
    assert got[3].drop and got[3].cleaned == ""
    assert got[4].n_hit == 0 and got[4].cleaned == texts[4]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_query_on_table(spark):
    from tracewright.llm.queries import op6_decontaminate

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op6_decontaminate(spark, sf).collect()}
    grams = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(name))
    sizes = {len(g) for g in grams}
    for d in docs:
        w, hit, found = words_of(d.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := grams.get(tuple(w[i : i + n])):
                    found |= names
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert got[d.doc_id] == (len(w), len(hit), len(found), digest, bool(hit))
