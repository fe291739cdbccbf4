import random
import zlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from tracewright.llm import toxicity


def corpus(rng, rows):
    calm = [f"calm{i}" for i in range(200)]
    out = []
    for i in range(rows):
        bad = i % 4 == 0
        words = rng.choices(calm, k=rng.randint(5, 60)) + (rng.sample(["vilexx", "vileyy", "nastyzz"], 2) if bad else [])
        # An identity term goes along with toxicity in this sample, which the penalty has to undo.
        if rng.random() < (0.7 if bad else 0.05):
            words.append("women")
        elif rng.random() < 0.2:
            words.append("men")
        rng.shuffle(words)
        out.append((i, " ".join(words), int(bad)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def auc(scores, labels):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels, strict=True) if x for b, y in zip(scores, labels, strict=True) if not y]
    return sum(pairs) / len(pairs)


def test_held_out_ranking(spark):
    rows = corpus(random.Random(1), 600)
    docs, labels = tables(spark, rows)
    model = toxicity.learn(docs, labels.filter("doc_id % 3 > 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 0]
    assert auc([got[i].score for i, _ in held], [y for _, y in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_penalty_lowers_identity_weight():
    rows = corpus(random.Random(3), 600)
    words = [toxicity.text_words(t) for _, t, _ in rows]
    held = [toxicity._features(w) for w in words]
    pairs = [(h, toxicity._features(s)) for h, w in zip(held, words, strict=True) for s in toxicity.swapped(w)]
    labels = [y for _, _, y in rows]
    gap = []
    for used in ([], pairs):
        model = toxicity.fit(held, labels, used)
        logit = [np.log(model.score(t) / (1 - model.score(t))) for t in ("women calm1", "men calm1")]
        gap.append(abs(logit[0] - logit[1]))
    assert gap[1] < 0.5 * gap[0]


def test_swaps():
    assert toxicity.swapped({"calm", "x"}) == []
    assert toxicity.swapped({"women", "x"}) == [{"men", "x"}, {"men", "x"}]
    assert {"christians", "x"} in toxicity.swapped({"muslims", "x"})


def test_edges(spark):
    rows = corpus(random.Random(5), 80)
    docs, labels = tables(spark, rows)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (9999, 1, 1)], labels.schema))
    model = toxicity.learn(docs.withColumn("toxic", F.lit("clash")), labels)
    odd = documents(spark, [None, "", "vilexx " * 3, "%%"]).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(7))
    got = [r.score for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[3] < got[2]
    assert toxicity.score(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.score(odd, toxicity.learn(docs, none)).collect()} == {0}


def test_query_on_table(spark):
    from tracewright.llm.queries import op4_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.9
