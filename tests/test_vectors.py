"""Cell search against all pairs."""

import numpy as np
import pytest

from tracewright.operators import vectors as V

QUERIES, CORPUS = "query_id long, vector array<double>", "doc_id long, vector array<double>"


def plain(queries, corpus, k):
    out = set()
    for name, q in queries:
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
        scored = sorted((-round(float(unit(q) @ unit(d)), 6), i) for i, d in corpus)[:k]
        out |= {(name, i, -s + 0.0) for s, i in scored}
    return out


def clustered(rng, n, spread):
    centres = rng.normal(size=(6, 8)) * 5
    return [(i, (centres[i % 6] + rng.normal(size=8) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize(
    "options", [{}, {"query_rows": 7, "corpus_rows": 9, "tile_pairs": 20}, {"cell_rows": 20, "max_cells": 6}, {"cell_rows": 5, "query_rows": 10, "corpus_rows": 4}]
)
def test_against_all_pairs(spark, options):
    rng = np.random.default_rng(len(options))
    corpus = clustered(rng, 150, 0.3) + [(1000, [0.0] * 8)]
    queries = clustered(rng, 40, 0.5) + [(77, [0.0] * 8), (78, rng.normal(size=8).tolist())]
    asked = spark.createDataFrame([*queries, (99, None)], QUERIES)
    held = spark.createDataFrame([*corpus, (2000, None)], CORPUS).repartition(4)
    hits, _ = V.cell_search(asked, held, 5, **options)
    got = {(r.query_id, r.doc_id, round(r.score, 6) + 0.0) for r in hits.collect()}
    assert got == plain(queries, corpus, 5)


def test_far_cells_are_skipped(spark):
    """Ten times the queries, most pairs never scored, the same hits."""
    rng = np.random.default_rng(5)
    corpus, queries = clustered(rng, 300, 0.05), clustered(rng, 600, 0.05)
    asked, held = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(corpus, CORPUS)
    options = {"cell_rows": 50, "max_cells": 6}
    row = V.skipped_share(asked, held, 4, **options).first()
    assert row.pairs == 180_000 and row.skipped > 0.7
    got = {(r.query_id, r.doc_id, round(r.score, 6)) for r in V.cell_search(asked, held, 4, **options)[0].collect()}
    assert got == plain(queries, corpus, 4)


def test_few_rows(spark):
    asked, held = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES), spark.createDataFrame([(5, [0.0, 0.0])], CORPUS)
    assert [tuple(r) for r in V.cell_search(asked, held, 3)[0].collect()] == [(1, 5, 0.0)]
    for a, h in ((asked.limit(0), held), (asked, held.limit(0))):
        hits, pairs = V.cell_search(a, h, 3)
        assert hits.count() == pairs.count() == 0 and hits.columns == ["query_id", "doc_id", "score"]
    assert V.skipped_share(asked.limit(0), held, 3).first().pairs == 0


def test_centres_and_ties():
    units = V.unit_rows(np.array([[1.0, 0], [2, 0], [0, 1], [0, 0], [-1, 0]]))
    assert V.choose_centres(units, 9).tolist() == [[1, 0], [-1, 0], [0, 1]]
    rows, cols = V.best_of_tile(np.array([[0.5, 0.5, 0.1, 0.5], [0, 0, 0, 1]]), np.array([9, 3, 1, 4]), 2)
    assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 3), (1, 2)]


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_vectors_are_moved_once_however_many_blocks_meet(spark):
    """Many small blocks: the bytes shuffled are those of the vectors, not of their pairs."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(800)]
    asked, held = spark.createDataFrame(rows, QUERIES), spark.createDataFrame(rows, CORPUS)
    before = shuffled_bytes(spark)
    hits = V.cell_search(asked, held, 3, query_rows=20, corpus_rows=20, max_cells=1)[0]
    assert hits.count() == 2400
    assert shuffled_bytes(spark) - before < 6 * 800 * 32 * 8
