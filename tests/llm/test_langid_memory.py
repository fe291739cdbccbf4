"""What a language fit takes beside Spark's driver."""

import tracemalloc

import numpy as np

from tracewright.llm import langid


def test_inverse_in_place():
    rng = np.random.default_rng(1)
    for size in (1, 5, langid.BLOCK, 3 * langid.BLOCK + 7):
        half = rng.standard_normal((size, size))
        matrix = half @ half.T + np.eye(size)
        given = matrix.copy()
        langid.invert(matrix)
        assert np.allclose(matrix @ given, np.eye(size), atol=1e-8)


def test_a_fit_holds_one_kernel():
    rng = np.random.default_rng(2)
    vectors = rng.random((1200, langid.BUCKETS), np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tracemalloc.start()
    model = langid.fit(vectors, ["de", "en", "fr"] * 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * 8 * 1200**2
    kernel = (vectors @ vectors.T).astype(np.float64) + 1.0 + np.eye(1200) * langid.RIDGE * 12
    target = model.codes[np.tile([0, 1, 2], 400)].astype(np.float64)
    assert np.allclose(model.planes, vectors.T @ np.linalg.solve(kernel, target), atol=1e-4)


def test_vectors_are_sent_without_their_zeros():
    langs, places, found = langid._vector_rows([["en", "de", "xx"], ["a short text", "ein kurzer Text", "123"]])
    assert langs == ["en", "de"] and sum(map(len, places + found)) < langid.BUCKETS
    vector = np.zeros(langid.BUCKETS, np.float32)
    vector[np.frombuffer(places[0], "<u2")] = np.frombuffer(found[0], "<f4")
    assert (vector == langid.features("a short text")).all()
