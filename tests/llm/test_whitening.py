from fractions import Fraction

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tracewright.llm import whitening
from tracewright.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def residue(a, values, vectors):
    size = np.abs(a).max()
    return float(np.abs(a @ vectors - vectors * values).max() / size), float(np.abs(vectors.T @ vectors - np.eye(len(a))).max())


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    q = q.astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(q)) - 0.5 * (q.T @ q))
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [9, 5, 3, 1, 0.5],
        [1 + 1e-9, 1, 1 - 1e-9, 0.3, 0.3 + 1e-12, 1e-3],
        [2, 2, 2, 1, 1, 0, 0],
        [1 + i * 1e-7 for i in range(12)],
        list(np.geomspace(1e6, 1e-6, 30)),
    ],
)
def test_eigenvectors_in_extended_precision(values):
    a = symmetric(np.random.default_rng(1), values)
    found, vectors = whitening.eigenvectors(a)
    assert np.abs(found - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-16 * max(values)
    off, skew = residue(a, found, vectors)
    assert off < 2e-17 and skew < 2e-16
    assert (np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0) > 0).all()


def test_correction_beats_single_precision():
    a = symmetric(np.random.default_rng(2), list(np.linspace(1, 2, 40)))
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    values = (start * (a @ start)).sum(axis=0)
    assert residue(a, values, start)[0] > 1e-9 > 1e-17 > residue(a, *whitening.eigenvectors(a))[0]


def test_matrices_without_directions():
    values, vectors = whitening.eigenvectors(np.zeros((3, 3)))
    assert not values.any() and (vectors == np.eye(3)).all()
    values, vectors = whitening.eigenvectors(np.array([[4.0]]))
    assert values[0] == 4 and vectors[0, 0] == 1


@pytest.mark.parametrize("bits", [4, 17, 19, 40, 51])
def test_exact_products(bits):
    rng = np.random.default_rng(bits)
    y = rng.integers(-(1 << bits), 1 << bits, size=(50, 4))
    big = y.astype(object)
    assert (whitening.products(y) == big.T @ big).all()


def plain(vectors, scale=1024, offset=100000, components=8):
    """Whitened rows by exact fractions and double-precision eigenvectors."""
    x = [[int(np.floor(scale * float(np.float32(c)))) + offset for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * r[j] - total[j] for j in range(d)] for r in x]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in far), n**3)) for j in range(d)] for i in range(d)]
    values, found = np.linalg.eigh(np.array(cov))
    order = np.argsort(-values)[:components]
    z = np.array(far, float) / n
    return n, [sum(c * c for c in r) for r in far], z @ found[:, order] / np.sqrt(values[order]), values[order] / np.trace(np.array(cov))


def check(found, ids, vectors, components=8):
    n, deviation, whitened, explained = plain(vectors, components=components)
    got = {}
    for r in found.collect():
        assert r.n == n
        got.setdefault(r.vec_id, {})[r.component] = r
        assert r.identity_error < 1e-9
    assert sorted(got) == sorted(ids) and all(sorted(v) == list(range(1, whitened.shape[1] + 1)) for v in got.values())
    for k in range(whitened.shape[1]):
        made = np.array([got[i][k + 1].whitened for i in ids])
        sign = np.sign(made @ whitened[:, k])
        assert np.abs(made * sign - whitened[:, k]).max() < 1e-7
        assert all(abs(got[i][k + 1].explained - explained[k]) < 1e-9 for i in ids)
    assert [got[i][1].deviation for i in ids] == deviation


def test_rows_against_plain_version(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 10)) * np.linspace(0.2, 3, 10)).astype(np.float32).tolist()
    odd = [None, [], [1.0] * 9, [float("nan")] + [0.0] * 9, [None] + [0.0] * 9, [float("inf")] * 10]
    table = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, v, 0) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(table, SCHEMA).withColumn("component", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(5)
    check(whitening.whiten(frame, whitening.fit(frame)), list(range(300)), vectors)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(40, 3)) * 1e6).astype(np.float32).tolist()
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    n, deviation, _, _ = plain(vectors)
    found = whitening.whiten(frame, whitening.fit(frame))
    want = [d if d < 1 << 63 else None for d in deviation]
    assert rows(found.filter("component = 1"), "vec_id", "deviation") == sorted([(i, d) for i, d in enumerate(want)], key=repr)
    far = spark.createDataFrame([(i, [s * 3e38, float(i)], 0) for i, s in enumerate((1.0, -1.0, 1.0))], SCHEMA)
    found = whitening.whiten(far, whitening.fit(far)).collect()
    assert len(found) and all(r.deviation is None for r in found)


def test_few_and_flat_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (None, [3.0, 6.0], 0)], SCHEMA)
    found = whitening.whiten(frame, whitening.fit(frame)).collect()
    # One direction only: the other has no variance.
    assert sorted((r.vec_id is None, r.component) for r in found) == [(False, 1), (False, 1), (True, 1)]
    assert all(abs(r.explained - 1) < 1e-12 for r in found)
    for few in (frame.limit(1), frame.limit(0), frame.filter("vec_id > 5").withColumn("embedding", F.lit(None).cast("array<float>"))):
        made = whitening.whiten(few, whitening.fit(few))
        assert made.count() == 0 and made.columns[0] == "vec_id"


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(QUERIES["op13_whitening"](spark, sf), [r.vec_id for r in table], [r.embedding for r in table])
