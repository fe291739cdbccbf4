import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import topk


def plain(rows, is_query, k, scale=64):
    whole = {}
    table = []
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        table.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))
    for vec_id, v in table:
        if is_query(vec_id):
            whole[vec_id] = min(whole.get(vec_id, v), v)
    out = set()
    for q, asked in whole.items():
        found = [(-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in table if i != q and len(v) == len(asked)]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("options", [{}, {"k": 3, "candidate_rows": 40, "query_rows": 3, "pivots": 4}, {"k": 25, "pivots": 1, "candidate_rows": 70}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(len(options))
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2 * (i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # a group of equal vectors: ties
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, **options).collect()
    assert {tuple(r) for r in got} == plain(rows, lambda i: i % 20 == 0, options.get("k", 20))
    assert len(got) == len(set(got))


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (40, [float("inf"), 1.0]),
        (5, [1.0, 2.0, 3.0]), (60, [2.0, 2.0, 2.0]), (None, [1.0, 1.0]), (6, [-0.001, 1e-9]), (6, [-0.001, 1e-9]), (20, [0.5, -1.0]),
    ]
    docs = vectors(spark, rows).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("distances", F.lit(2))
    got = [tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 20 == 0).collect()]
    want = plain(rows, lambda i: i % 20 == 0, 20)
    assert {(q, i, s) for q, _, i, s in got} == {(q, i, s) for q, _, i, s in want}
    assert len(got) == 4 + 3 + 1  # repeated candidates count each; the query's own rows do not
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(docs, F.col("vec_id") == 77).count() == 0


def test_large_components_stay_exact():
    big = np.array([[2**26, 1], [2**26, 0], [-(2**26), 3]], np.int64)
    pivots = big[:1].astype(float)
    table = topk._distances(big.astype(float), pivots)
    _, ids, scores = topk.search_block(np.array([9]), big[:1], table[:1], np.array([0, 1, 2]), big, table, 3)
    assert dict(zip(ids.tolist(), scores.tolist(), strict=True)) == {0: 2**52 + 1, 1: 2**52, 2: -(2**52) + 3}


def test_stops_before_all_candidates(monkeypatch):
    rng = np.random.default_rng(0)
    both = np.concatenate([rng.integers(60, 66, (200, 8)), -rng.integers(50, 70, (4000, 8))])
    pivots = topk.choose_pivots(both.astype(float), 8)
    table = topk._distances(both.astype(float), pivots)
    batches = []
    real = topk._best
    monkeypatch.setattr(topk, "BATCH", 100)
    monkeypatch.setattr(topk, "_best", lambda *a: batches.append(1) or real(*a))
    _, ids, scores = topk.search_block(np.array([-1]), both[:1], table[:1], np.arange(len(both)), both, table, 20)
    want = sorted(((-int(both[0] @ v), i) for i, v in enumerate(both)))[:20]
    assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    assert len(batches) < 6


@pytest.mark.parametrize("batch", [3, 7, 1000])
def test_blocks_with_many_ties(monkeypatch, batch):
    monkeypatch.setattr(topk, "BATCH", batch)
    monkeypatch.setattr(topk, "TILE", 4)
    rng = np.random.default_rng(batch)
    vectors = rng.integers(-1, 2, (90, 3))
    ids = rng.permutation(90)
    table = topk._distances(vectors.astype(float), topk.choose_pivots(vectors.astype(float), 4))
    q, found, scores = topk.search_block(ids[:11], vectors[:11], table[:11], ids, vectors, table, 5)
    got = set(zip(q.tolist(), found.tolist(), scores.tolist(), strict=True))
    want = set()
    for a, v in zip(ids[:11], vectors[:11], strict=True):
        best = sorted((-int(v @ w), int(i)) for i, w in zip(ids, vectors, strict=True) if i != a)[:5]
        want |= {(int(a), i, -s) for s, i in best}
    assert got == want


def test_query_on_table(spark):
    from tracewright.llm.queries import op3_topk

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op3_topk(spark, sf).collect()} == plain(rows, lambda i: i % 20 == 0, 20)
