"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import map_columns, ship_package
from tracewright.session import cut_lineage

K = 20
SCALE = 64
PIVOTS = 16
PIVOT_SAMPLE = 4096  # vectors among which pivots are chosen
CANDIDATE_ROWS = 4096  # candidates of a block
QUERY_ROWS = 16384  # queries of a block
TILE = 128  # queries bounded at a time
BATCH = 1024  # candidates evaluated between two stopping tests
EXACT = 2**53  # sums below this are exact in double precision


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that take no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(finite & (F.size(vector) > 0), whole)


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first vectors of ``sample``, starting with the one farthest from the mean."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the distances to the pivots of their dimension."""

    def table(columns: list[list]) -> list[list]:
        ids, lists = columns
        return [ids, lists, [_distances(np.array([v], float), pivots[len(v)])[0] for v in lists]]

    def blockwise(columns: list[list]) -> list[list]:
        ids, lists = columns
        if len({len(v) for v in lists}) != 1:
            return table(columns)
        return [ids, lists, list(_distances(np.array(lists, float), pivots[len(lists[0])]))]

    return map_columns(vectors, "vec_id long, vector array<long>, distances array<double>", blockwise)


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of every row, by falling score, then id."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return order[rank < k]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, query_pivots: np.ndarray,
    ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int = K,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of the block for each query, ties to smaller ids, the query's own id left out.

    The largest difference to a pivot bounds the distance from below, so
    (|q|^2 + |x|^2 - bound^2) / 2 bounds the inner product from above.
    Candidates are evaluated by falling bound, BATCH at a time for a tile of
    queries; the tile stops when no remaining bound reaches the k-th score of any
    of its queries, which keeps ties whole.
    """
    exact = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) < EXACT
    kind = np.float64 if exact else np.int64
    least = -np.inf if exact else np.iinfo(np.int64).min
    multiplied, asked = vectors.astype(kind), queries.astype(kind)
    halves = (vectors.astype(float) ** 2).sum(axis=1)
    columns = np.ascontiguousarray(pivots.T, np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), TILE):
        stop = min(start + TILE, len(queries))
        near = query_pivots[start:stop].astype(np.float32)
        bound, apart = np.zeros((2, stop - start, len(ids)), np.float32)
        for p, column in enumerate(columns):
            np.subtract(near[:, p, None], column[None], out=apart)
            np.abs(apart, out=apart)
            np.maximum(bound, apart, out=bound)
        # Room for rounding: the bound of the distance may only be too low, that of the product too high.
        norms = (queries[start:stop].astype(float) ** 2).sum(axis=1)
        largest = norms.max() + halves.max(initial=0)
        bound -= np.float32(1e-5 * np.sqrt(largest) + 1e-5)
        np.maximum(bound, 0, out=bound)
        np.multiply(bound, bound, out=bound)
        np.subtract(norms.astype(np.float32)[:, None], bound, out=bound)
        peak = (bound.max(axis=0).astype(float) + halves) / 2 + 1e-6 * largest
        order = np.argsort(-peak, kind="stable")
        floor = np.full(stop - start, least, kind)
        row, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for at in range(0, len(order), BATCH):
            now = order[at : at + BATCH]
            if peak[now[0]] < floor.min():
                break
            product = asked[start:stop] @ multiplied[now].T
            own = query_ids[start:stop, None] == ids[now][None]
            if len(now) > k:
                ranked = np.where(own, least, product)
                floor = np.maximum(floor, np.partition(ranked, len(now) - k, axis=1)[:, len(now) - k])
            rows, places = np.nonzero(~own & (product >= floor[:, None]))
            row, found = np.r_[row, rows], np.r_[found, now[places]]
            scores = np.r_[scores, product[rows, places]]
            best = _best(row, ids[found], scores, k)
            row, found, scores = row[best], found[best], scores[best]
            full = np.bincount(row, minlength=stop - start) >= k
            worst = np.full(stop - start, least, kind)
            last = np.r_[row[1:] != row[:-1], True]
            worst[row[last]] = scores[last]
            floor = np.where(full, np.maximum(floor, worst), floor)
        out.append((query_ids[start:stop][row], ids[found], scores.astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), -1)


def _searcher(k: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = search_block(
            queries["query_id"].to_numpy(), _matrix(queries["vector"], np.int64), _matrix(queries["distances"], float),
            block["vec_id"].to_numpy(), _matrix(block["vector"], np.int64), _matrix(block["distances"], float), k,
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    candidate_rows: int = CANDIDATE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows by integer inner product.

    Queries are the rows for which ``is_query`` (a condition on the id column)
    holds; of a repeated query id the smallest vector is asked. Candidates are all
    rows but those with the query's id; repeated candidates count each. Vectors
    that are null, empty or hold null or non-finite components take no part, nor
    do null ids. Vectors meet those of their own length only. Ties go to the
    smaller id. An empty table gives no rows.

    Pivots come from PIVOT_SAMPLE vectors; the table of distances to them covers
    every row. Candidates and queries are dealt to blocks by row number, so
    repeated vectors spread, and each pair of blocks is one task's group of
    bounded size, which returns at most k rows per query.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(PIVOT_SAMPLE).select("vector").toArrow()["vector"].to_pylist()
    sizes = [r[0] for r in rows.select(F.size("vector")).distinct().limit(PIVOT_SAMPLE).collect()]
    by_size = {n: choose_pivots(np.array([v for v in sample if len(v) == n], float).reshape(-1, n), pivots) for n in sizes}
    table = cut_lineage(_pivot_table(rows, by_size))
    total = table.count()
    asked = (
        table.withColumnRenamed("vec_id", id_col).filter(is_query).select(F.col(id_col).alias("query_id"), "vector", "distances")
        .groupBy("query_id").agg(F.min(F.struct("vector", "distances")).alias("row")).select("query_id", "row.*")
    )
    asked = cut_lineage(asked)
    blocks, query_blocks = max(1, -(-total // candidate_rows)), max(1, -(-asked.count() // query_rows))
    number = F.monotonically_increasing_id()
    held = table.select(
        "vec_id", "vector", "distances", F.size("vector").alias("size"), F.pmod(number, F.lit(blocks)).cast("int").alias("block")
    ).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = asked.select(
        "query_id", "vector", "distances", F.size("vector").alias("size"), F.pmod(number, F.lit(query_blocks)).cast("int").alias("query_block")
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["size", "query_block", "block"]
    found = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
