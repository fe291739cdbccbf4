"""Toxicity scores by a linear classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, hash_sample, map_arrow, map_columns, rows_of

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18  # hashed features
PREFIXES = (4, 6)  # letters of the word beginnings that are features beside whole words
SAMPLE_ROWS = 4000  # labelled rows that a fit sees at most, half of each label
LEAST_ROWS = 3  # sample rows that must hold a feature
ROUNDS = 150
RATE = 0.2
LASSO = 2e-3  # drives the weights of uninformative features to zero
BALANCE = 1.0  # weight of the counterfactual penalty
CACHED = 300_000  # words whose features a worker keeps

# Identity terms; a term may be swapped for any other of its group.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus"),
    ("schwul", "lesbisch", "hetero"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("homosexuel", "lesbienne", "hétéro"), ("immigrés", "réfugiés", "étrangers"), ("noirs", "blancs", "arabes"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
    ("homosexual", "lesbiana", "heterosexual"), ("inmigrantes", "refugiados", "extranjeros"), ("negros", "blancos", "árabes"),
)
GROUP_OF = {term: group for group in IDENTITY_TERMS for term in group}


def _bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_features(word: str) -> tuple[int, ...]:
    return (_bucket("=", word), *(_bucket(f"{n}^", word[:n]) for n in PREFIXES if len(word) >= n))


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in word_features(w)})


def swapped(words: set[str]) -> list[set[str]]:
    """Counterfactual word sets: every identity term replaced by the next, and by the one before, of its group."""
    named = {w: GROUP_OF[w] for w in words if w in GROUP_OF}
    if not named:
        return []
    return [
        {g[(g.index(w) + step) % len(g)] if (g := named.get(w)) else w for w in words} for step in (1, -1)
    ]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str | None) -> float:
        """Probability-like score of the features that the whole text holds."""
        held: set[int] = set()
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for word in text_words(text):
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(f for f in word_features(word) if self.weights[f])
            held.update(found)
        logit = self.bias + float(self.weights[sorted(held)].sum()) if held else self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _rows(lists: list[list[int]], column_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the nonzero entries; features without a column are left out."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = column_of[np.concatenate([np.array(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])]
    return row[column >= 0], column[column >= 0]


def fit(held: list[list[int]], toxic: list[int], pairs: list[tuple[list[int], list[int]]]) -> ToxicityModel:
    """Logistic regression by proximal gradient steps with a rate per feature.

    Both labels weigh the same. ``pairs`` are feature lists of a text and of its
    counterfactual; the squared differences of their logits are part of the
    loss, which moves weight away from identity terms.
    """
    label = np.array(toxic, np.float64)
    if not len(label) or label.min() == label.max():
        base = float(label.mean()) if len(label) else 0.0
        return ToxicityModel(np.zeros(BUCKETS), 4.0 if base > 0.5 else -4.0)
    seen = np.bincount(np.concatenate([np.array(x, np.int64) for x in held]), minlength=BUCKETS)
    kept = np.flatnonzero(seen >= min(LEAST_ROWS, len(label)))
    column_of = np.full(BUCKETS, -1)
    column_of[kept] = np.arange(len(kept))
    row, column = _rows(held, column_of)
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    left, right = _rows([a for a, _ in pairs], column_of), _rows([b for _, b in pairs], column_of)
    n, m, width = len(label), len(pairs), len(kept)
    weights, bias, squares, bias_square = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(ROUNDS):
        logit = np.bincount(row, weights[column], n) + bias
        error = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        slope = np.bincount(column, error[row], width)
        if m:
            gap = np.bincount(left[0], weights[left[1]], m) - np.bincount(right[0], weights[right[1]], m)
            pull = 2 * BALANCE / m * gap
            slope += np.bincount(left[1], pull[left[0]], width) - np.bincount(right[1], pull[right[0]], width)
        squares += slope**2
        rate = RATE / np.sqrt(squares)
        moved = weights - rate * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * LASSO, 0)
        bias_square += error.sum() ** 2
        bias -= RATE / np.sqrt(bias_square) * error.sum()
    out = np.zeros(BUCKETS)
    out[kept] = weights
    return ToxicityModel(out, float(bias))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled documents, half of each label, taken by a hash of their id.

    A document with both labels counts as toxic; null labels and ids and labels
    without a document are left out. The driver gets one list of features per
    sampled row.
    """
    clean = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_toxic")).dropna()
    ids = docs.select(F.col(id_col).alias("_id"))
    marked = clean.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).join(ids, "_id", "left_semi")
    chosen = hash_sample(marked, "_toxic", "_id", sample_rows // 2)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("_toxic", "_text")
    schema = "toxic int, held array<int>, swaps array<array<int>>"
    rows = map_columns(texts, schema, _sample_rows).limit(sample_rows).toArrow().to_pylist()
    pairs = [(r["held"], other) for r in rows for other in r["swaps"]]
    return fit([r["held"] for r in rows], [int(r["toxic"] > 0) for r in rows], pairs)


def _sample_rows(columns: list[list]) -> list[list]:
    words = [text_words(t) for t in columns[1]]
    return [columns[0], [_features(w) for w in words], [[_features(s) for s in swapped(w)] for w in words]]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row of ``docs``; higher scores are likelier toxic.

    Null and empty texts get the score of a text without any feature. Repeated
    rows and null ids stay, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, predicted int"
    target = arrow_schema(schema)

    def run(batches):
        one = shared.value.score
        for names, texts in rows_of(batches):
            found = [float(one(t)) for t in texts]
            columns = [names, found, [int(s >= 0.5) for s in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return map_arrow(docs.select(id_col, text_col), run, schema)
