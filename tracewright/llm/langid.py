"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import CHUNK, hash_sample, map_columns, with_results

UNKNOWN = "und"
BUCKETS = 1 << 12  # hashed n-gram features
ORDERS = 3  # n-grams of one to three characters
SAMPLE_ROWS = 2000  # labelled rows that a fit sees at most
RIDGE = 0.02
STEP = 512  # features of the planes worked out at a time
BLOCK = 128  # rows of the kernel worked out at a time
SLOPE = 6.0  # of the score over decoding distances
AMBIGUOUS = 0.05  # relative gap of the two nearest codewords below which a text is ambiguous
EXHAUSTIVE = 7  # up to so many languages every split of them is a bit
LONG_BITS = 63
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of root n-gram counts; None if the text is null or has no letter.

    Texts are lower-cased; each run of other characters counts as one space.
    """
    counts = np.zeros(BUCKETS)
    any_letter = False
    for start in range(0, len(text or ""), CHUNK):
        codes = np.frombuffer(text[start : start + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        if not letter.any():
            continue
        any_letter = True
        codes = np.where(letter, codes, np.uint32(32))
        kept = np.r_[True, letter[1:] | letter[:-1]]
        codes = np.r_[np.uint32(32), codes[kept], np.uint32(32)].astype(np.uint32)
        mixed = np.zeros(len(codes), np.uint32)
        for order in range(ORDERS):
            mixed = (mixed[: len(codes) - order] + codes[order:]) * np.uint32(MULTIPLIERS[order])
            counts += np.bincount((mixed ^ mixed >> np.uint32(15)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
            mixed = mixed[:-1]
    if not any_letter:
        return None
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1, one per class.

    Up to EXHAUSTIVE classes: every split into two parts, once. Beyond: the
    LONG_BITS-column matrix with the largest least distance among 200 drawn by a
    fixed seed.
    """
    if classes <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(columns, np.float32).reshape(-1, classes).T
    rng = np.random.default_rng(0)
    drawn = [rng.choice(np.array([-1, 1], np.float32), (classes, LONG_BITS)) for _ in range(200)]
    return max(drawn, key=lambda m: ((LONG_BITS - m @ m.T) / 2 + LONG_BITS * np.eye(classes)).min())


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # language x bit: how far a bit is to be trusted for a language
    planes: np.ndarray  # feature x bit
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, score, ambiguous) of each text, by the smallest weighted loss."""
        found = [features(t) for t in texts]
        names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, f in enumerate(found) if f is not None]
        if not rows or not self.languages:
            return names, scores, unsure
        if len(self.languages) == 1:
            for i in rows:
                names[i], scores[i], unsure[i] = self.languages[0], 1.0, False
            return names, scores, unsure
        margins = np.stack([found[i] for i in rows]) @ self.planes + self.bias
        distance = (self.weights * np.exp(-self.codes * np.clip(margins, -2, 2)[:, None, :])).sum(axis=2)
        order = np.sort(distance, axis=1)
        share = np.exp(-SLOPE * (distance - order[:, :1]))
        for i, d, s, o in zip(rows, distance, share, order, strict=True):
            names[i] = self.languages[int(d.argmin())]
            scores[i] = float(1 / s.sum())
            unsure[i] = bool(o[1] - o[0] < AMBIGUOUS * o[1])
        return names, scores, unsure


def invert(matrix: np.ndarray) -> None:
    """Put the inverse of a symmetric positive definite matrix in its place, by Gauss-Jordan steps of BLOCK rows."""
    size = len(matrix)
    for low in range(0, size, BLOCK):
        own = slice(low, min(low + BLOCK, size))
        pivot = np.linalg.inv(matrix[own, own])
        rows, columns = pivot @ matrix[own], matrix[:, own].copy()
        rows[:, own] = pivot
        matrix[:, own] = 0
        for at in range(0, size, BLOCK):
            if at != low:
                matrix[at : at + BLOCK] -= columns[at : at + BLOCK] @ rows
        matrix[own] = rows


def fit(vectors: np.ndarray, labels: list[str]) -> LanguageModel:
    """Ridge classifiers for every bit; a bit's weight for a language is its leave-one-out accuracy there."""
    languages = sorted(set(labels))
    codes = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 0), np.float32)
    if len(languages) < 2:
        empty = np.zeros((BUCKETS, 0), np.float32)
        return LanguageModel(languages, codes, codes, empty, np.zeros(0, np.float32))
    of = np.array([languages.index(x) for x in labels])
    target = codes[of].astype(np.float64)
    # In place and by blocks of rows, without a copy of the kernel: the driver holds this beside Spark.
    kernel = np.empty((len(labels), len(labels)))
    for at in range(0, len(labels), BLOCK):
        kernel[at : at + BLOCK] = vectors[at : at + BLOCK] @ vectors.T
    kernel += 1.0
    kernel[np.diag_indices_from(kernel)] += RIDGE * len(labels) / 100
    invert(kernel)
    dual = kernel @ target
    left_out = target - dual / np.diag(kernel)[:, None]
    del kernel
    right = left_out * target > 0
    weights = np.stack([(right[of == c].sum(axis=0) + 1) / ((of == c).sum() + 2) for c in range(len(languages))])
    weights /= weights.sum(axis=1, keepdims=True)
    planes = np.empty((vectors.shape[1], codes.shape[1]), np.float32)
    for at in range(0, len(planes), STEP):
        planes[at : at + STEP] = vectors[:, at : at + STEP].T @ dual
    return LanguageModel(languages, codes, weights.astype(np.float32), planes, dual.sum(axis=0).astype(np.float32))


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> LanguageModel:
    """Fit on at most ``sample_rows`` rows with a language, as many of each, taken by a hash of their id.

    The choice reads ids and languages of all rows; only the chosen rows' texts
    are read. The driver gets one vector per chosen row, as its places and values
    other than zero. Rows whose text is null or has no letter teach nothing.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    kinds = known.groupBy(lang_col).count().limit(sample_rows).count()
    if not kinds:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    keys = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    chosen = hash_sample(keys, "_lang", "_id", max(1, sample_rows // kinds)).select("_id").distinct()
    texts = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    texts = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("_lang", "_text")
    rows = map_columns(texts, "lang string, places binary, found binary", _vector_rows).limit(sample_rows).toArrow()
    labels = rows["lang"].to_pylist()
    vectors = np.zeros((len(labels), BUCKETS), np.float32)
    for at, (places, found) in enumerate(zip(rows["places"], rows["found"], strict=True)):
        vectors[at, np.frombuffer(places.as_buffer(), "<u2")] = np.frombuffer(found.as_buffer(), "<f4")
    del rows
    pa.default_memory_pool().release_unused()
    return fit(vectors, labels)


def _vector_rows(columns: list[list]) -> list[list]:
    out: list[list] = [[], [], []]
    for lang, vector in zip(columns[0], map(features, columns[1]), strict=True):
        if vector is not None:
            places = np.flatnonzero(vector)
            for column, value in zip(out, (lang, places.astype("<u2").tobytes(), vector[places].astype("<f4").tobytes()), strict=True):
                column.append(value)
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row of ``docs``, from its whole text alone.

    With ``carry``, all columns of ``docs`` and these with a leading underscore.

    ``lang_pred`` is a learned language, or ``und`` (score 0, ambiguous) if the
    text is null or has no letter, or if nothing was learned. Ties go to the
    language first in alphabetical order. Repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_results(
        docs, [text_col], "lang_pred string, score double, ambiguous boolean",
        lambda columns: shared.value.predict(columns[0]), carry, [id_col],
    )
