"""Exact cosine top-k: cells of vectors around centres, searched in pairs of written blocks that are read, not shuffled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tracewright.operators.skew import top_n
from tracewright.session import cut_lineage, ship_package

SAMPLE = 4096  # corpus vectors of which centres are chosen; they only decide what is skipped, never the result
CELLS = 64
CELL_ROWS = 8192  # corpus vectors per cell that are aimed at
CORPUS_ROWS, QUERY_ROWS = 4096, 1024  # of a block
TILE_PAIRS = 4 * 1024 * 1024  # scores that a task holds: 32 MB
SLACK = 2e-6  # scores are rounded to six digits
RIGHT_ANGLE = np.pi / 2


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of unit vectors to unit centres; a zero vector is at a right angle to everything, like its cosine."""
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def choose_centres(units: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the unit vectors, each the farthest from those before it."""
    units = units[np.linalg.norm(units, axis=1) > 0]
    if not len(units):
        return units
    chosen = [0]
    near = angles(units, units[:1])[:, 0]
    while len(chosen) < n and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(units, units[chosen[-1:]])[:, 0])
    return units[chosen]


def best_of_tile(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every row: higher score, then smaller id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero(scores >= least[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((docs[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    kept = np.arange(len(rows)) - first[rows] < k
    return rows[kept], cols[kept]


def _placed(vectors: DataFrame, id_col: str, centres: np.ndarray) -> DataFrame:
    """(id, unit vector, nearest centre, angles to all centres), written."""
    schema = f"{id_col} {dict(vectors.dtypes)[id_col]}, vector array<double>, cell int, angles array<double>"

    def place(batches):
        for batch in batches:
            if len(batch):
                units = unit_rows(_matrix(batch["vector"]))
                apart = angles(units, centres)
                yield pd.DataFrame({id_col: batch[id_col], "vector": list(units), "cell": apart.argmin(axis=1).astype("int32"), "angles": list(apart)})

    return cut_lineage(vectors.filter("vector is not null").select(id_col, "vector").mapInPandas(place, schema))


def _by_cell(values: dict[int, int], default: int) -> Column:
    pairs = [x for cell, value in values.items() for x in (F.lit(cell), F.lit(value))]
    return F.coalesce(F.create_map(*pairs)[F.col("cell")], F.lit(default)) if pairs else F.lit(default)


@dataclass
class Cells:
    """The corpus by cells: rows and largest angle to the centre of each, and the vectors in written blocks."""

    blocks: DataFrame
    sizes: dict[int, int]
    radius: dict[int, float]
    id_type: str


def _blocks(rows: DataFrame, id_col: str, sizes: dict[int, int], block_rows: int, prefix: str) -> DataFrame:
    """Rows (id, vector, cell, open cells) in written blocks of about ``block_rows``, all of one cell: one row a block.

    Every vector is moved once. ``cells`` are those open to any row of the block, ``mask`` tells which are open to each row.
    """
    parts = {cell: -(-n // block_rows) for cell, n in sizes.items()}
    part = F.pmod(F.xxhash64(id_col, "vector"), _by_cell(parts, 1)).cast("int")
    columns = f"cell int, part int, ids array<{dict(rows.dtypes)[id_col]}>, vectors binary, cells array<int>, mask binary".split(", ")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        cells = sorted({int(c) for row in frame["open"] for c in row})
        place = {c: i for i, c in enumerate(cells)}
        mask = np.zeros((len(frame), len(cells)), bool)
        for i, row in enumerate(frame["open"]):
            mask[i, [place[int(c)] for c in row]] = True
        values = int(frame["cell"].iloc[0]), int(frame["part"].iloc[0]), frame["ids"].tolist(), _matrix(frame["vector"]).tobytes(), cells, mask.tobytes()
        return pd.DataFrame({f"{prefix}{c.split()[0]}": [v] for c, v in zip(columns, values, strict=True)})

    dealt = rows.select("cell", part.alias("part"), F.col(id_col).alias("ids"), "vector", "open")
    return cut_lineage(dealt.groupBy("cell", "part").applyInPandas(pack, ", ".join(f"{prefix}{c}" for c in columns)))


def _merged(best: tuple | None, more: tuple, k: int) -> tuple:
    """The k best (row, score, doc) of every row of both."""
    rows, scores, docs = more if best is None else (np.concatenate(x) for x in zip(best, more, strict=True))
    order = np.lexsort((docs, -scores, rows))
    rows, scores, docs = rows[order], scores[order], docs[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], scores[kept], docs[kept]


def _search(asked: DataFrame, cells: Cells, k: int, query_rows: int, tile_pairs: int) -> DataFrame:
    """k best hits of every (query_id, vector, cell, open) row in its open cells.

    Blocks of both sides meet in a product of the two written tables, which tasks read: no vector is copied by a shuffle, and a
    task gives its k best of a query over all blocks it has read. Spark bounds the bytes of the batches that blocks travel in.
    """
    counts = {row["cell"]: row["count"] for row in asked.groupBy("cell").count().collect()}
    blocks = _blocks(asked, "query_id", counts, query_rows, "q_")
    meet = blocks.join(cells.blocks, F.array_contains("q_cells", F.col("d_cell")))
    schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id {cells.id_type}, score double"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def score(batches):
        best: dict[tuple, tuple] = {}
        names: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in ("q_cell", "q_part", "q_ids", "q_vectors", "q_cells", "q_mask", "d_cell", "d_ids", "d_vectors")}
                of = row["q_cell"].as_py(), row["q_part"].as_py()
                if of not in names:
                    names[of] = row["q_ids"].values.to_numpy(zero_copy_only=False).copy()
                open_cells = row["q_cells"].as_py()
                mask = np.frombuffer(row["q_mask"].as_buffer(), bool).reshape(-1, len(open_cells))
                asking = np.flatnonzero(mask[:, open_cells.index(row["d_cell"].as_py())])
                docs = row["d_ids"].values.to_numpy(zero_copy_only=False)
                left = np.frombuffer(row["q_vectors"].as_buffer()).reshape(len(mask), -1)
                right = np.frombuffer(row["d_vectors"].as_buffer()).reshape(len(docs), -1).T
                step = max(1, tile_pairs // len(docs))
                for start in range(0, len(asking), step):
                    some = asking[start : start + step]
                    # Rounded score first, then the smaller id, as in the final ranking.
                    scores = np.round(left[some] @ right, 6)
                    rows, cols = best_of_tile(scores, docs, k)
                    best[of] = _merged(best.get(of), (some[rows], scores[rows, cols], docs[cols]), k)
        for of, (rows, scores, docs) in best.items():
            arrays = [pa.array(x, f.type) for x, f in zip((names[of][rows], docs, scores), target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return meet.select("q_cell", "q_part", "q_ids", "q_vectors", "q_cells", "q_mask", "d_cell", "d_ids", "d_vectors").mapInArrow(score, schema)


def cell_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    max_cells: int = CELLS,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
    corpus_rows: int = CORPUS_ROWS,
    tile_pairs: int = TILE_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """(hits, asked): exact cosine top-k (query_id, doc_id, score), and the (query_id, cell) that were searched with the cell's rows.

    Every vector lies in the cell of its nearest centre. A query's own cell gives its first k scores. Angles obey the triangle
    inequality, so no vector of another cell is nearer to the query than the angle to the cell's centre less the cell's radius:
    cells that cannot reach the k-th score are skipped, the others searched. Null vectors take no part; a zero vector has score 0.
    Neither queries nor corpus reach the driver, but for a bounded sample and one row per cell.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    id_type = dict(corpus.dtypes)["doc_id"]
    hits = spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, doc_id {id_type}, score double")
    nothing = spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, cell int, size long")
    known = corpus.filter("vector is not null")
    total = known.count()
    if not total:
        return hits, nothing
    sample = known.select("doc_id", "vector").orderBy(F.xxhash64("doc_id", "vector")).limit(SAMPLE).toArrow()["vector"].to_pylist()
    centres = choose_centres(unit_rows(np.array(sample, float)), min(max_cells, max(1, total // cell_rows)))
    if not len(centres):
        centres = np.zeros((1, len(sample[0])))
    rows = _placed(known, "doc_id", centres)
    own = F.element_at("angles", F.col("cell") + 1)
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("radius")).collect()
    sizes = {r["cell"]: r["n"] for r in stats}
    blocks = _blocks(rows.withColumn("open", F.array().cast("array<int>")), "doc_id", sizes, corpus_rows, "d_")
    cells = Cells(blocks, sizes, {r["cell"]: r["radius"] for r in stats}, id_type)
    asking = _placed(queries, "query_id", centres)
    # The nearest cell that holds anything.
    filled = F.array(*[F.lit(c) for c in sorted(cells.sizes)])
    angle = lambda c: F.element_at("angles", c + 1)
    home = F.array_min(F.transform(filled, lambda c: F.struct(angle(c).alias("angle"), c.alias("cell"))))["cell"]
    asking = asking.withColumn("cell", home)
    search = lambda asked: _search(asked, cells, k, query_rows, tile_pairs)
    first = top_n(search(asking.withColumn("open", F.array("cell"))), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    asked = asking.select("query_id", "cell")
    size = _by_cell(cells.sizes, 0).cast("long").alias("size")
    if len(cells.sizes) < 2:
        return first, asked.select("query_id", "cell", size)
    first = cut_lineage(first)
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0)
    reach = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(float(cells.radius[c])).alias("radius")) for c in sorted(cells.sizes)])
    bound = lambda c: F.cos(F.greatest(F.lit(0.0), angle(c["cell"]) - c["radius"]))
    open_cells = F.filter(reach, lambda c: (c["cell"] != F.col("cell")) & (bound(c) + SLACK >= F.coalesce(floor, F.lit(-2.0))))
    further = cut_lineage(
        asking.join(floors, "query_id", "left").withColumn("open", F.transform(open_cells, lambda c: c["cell"]))
        .filter(F.size("open") > 0).select("query_id", "vector", "cell", "open")
    )
    out = top_n(first.unionByName(search(further)), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return out, asked.unionByName(further.select("query_id", F.explode("open").alias("cell"))).select("query_id", "cell", size)


def skipped_share(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """One row: pairs of queries and corpus vectors, how many were scored, and the share that was not."""
    _, asked = cell_search(queries, corpus, k, **options)
    scored = asked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("scored"))
    sizes = [df.filter("vector is not null").agg(F.count(F.lit(1)).alias(name)) for df, name in ((queries, "asked"), (corpus, "held"))]
    pairs = F.col("asked") * F.col("held")
    together = sizes[0].join(sizes[1], F.lit(True)).join(scored, F.lit(True))
    return together.select(pairs.alias("pairs"), "scored", F.when(pairs > 0, 1 - F.col("scored") / pairs).alias("skipped"))
