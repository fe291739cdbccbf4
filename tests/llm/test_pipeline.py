import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_hits
from test_linededup import plain as plain_lines
from test_near_copies import gone_of
from test_packing import check, tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output as rows by id, written and read like the driver does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = ({r.doc_id: r for r in before}, docs.collect(), docs.columns)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "packing"]
    assert all(stages[n][2] == COLUMNS for n in ("language", "lines", "near_copies", "benchmark"))


def test_language_keeps_rows_as_they_are(stages):
    before, after, _ = stages["language"]
    assert all(before[r.doc_id] == r for r in after) and len(after) >= 0.98 * len(before)
    assert all(any(c.isalpha() for c in r.text) for r in after)


def test_lines(stages):
    before, after, _ = stages["lines"]
    ids = sorted(before)
    gone = {(ids[d], k) for d, k in plain_lines([before[i].text for i in ids])}
    want = {}
    for i in ids:
        kept = [x for k, x in enumerate(before[i].text.split("\n")) if (i, k) not in gone]
        text = "\n".join(kept)
        if text == before[i].text or text.strip():
            want[i] = text
    assert {r.doc_id: r.text for r in after} == want and len(want) < len(ids)
    assert all(r.n_chars == len(r.text) and r.lang == before[r.doc_id].lang for r in after)


def test_near_copies(stages):
    before, after, _ = stages["near_copies"]
    ids = sorted(before)
    gone = gone_of([before[i].text for i in ids])
    assert sorted(r.doc_id for r in after) == [doc for k, doc in enumerate(ids) if k not in set(gone)]
    assert all(before[r.doc_id] == r for r in after)


def test_benchmark(spark, stages):
    before, after, _ = stages["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in after}
    for i, r in list(before.items())[:120]:
        n, hits, _ = plain_hits(r.text, items)
        assert (i in got) == (not hits or hits < 0.8 * n)
        if not hits:
            assert got[i] == r
        elif i in got:
            assert len(got[i].text) < len(r.text) and got[i].n_chars == len(got[i].text)


def test_packing(stages):
    before, after, _ = stages["packing"]
    ids = {i: tokenizer().encode(r.text, add_special_tokens=False).ids for i, r in list(before.items())}
    check(after, ids, 2048)


def test_odd_rows_through_every_stage(spark, tmp_path):
    texts = [None, "", "12 34", "one line of plain words here\nand another one", "one line of plain words here\nand another one", "x " * 30000]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("text_words", "component", "fingerprint", "_lang_pred", "_n_lines", "_repeat_doc", "_cleaned", "score", "size", "sequence_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, frame in (("odd", docs), ("empty", docs.limit(0)), ("unlabelled", docs.withColumn("lang", F.lit(None).cast("string")))):
        now = frame
        for stage_name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            out = str(tmp_path / name / stage_name)
            now.write.parquet(out)
            now = spark.read.parquet(out)
            if stage_name != "packing":
                assert set(COLUMNS) <= set(now.columns)
            if (name, stage_name) == ("odd", "near_copies"):
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect()) == [(False, 3), (False, 5), (True, 0)]
        assert now.count() == 0 or name == "odd"


def test_query_is_the_stages(spark, stages):
    from tracewright.llm.queries import pipeline

    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pipeline(spark, SF).collect()}
    assert got == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages["packing"][1]}
