"""Embedding whitening: exact covariance on Spark, eigenvectors refined from single to extended precision."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, fresh_name, map_arrow

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LIMB_BITS = 18  # products of two limbs, summed over 2**17 rows, are exact in double precision
BLOCK_ROWS = 4096
MOST = float(1 << 51)  # grid values beyond it count as it
ROUNDS = 30
WIDE = np.longdouble


# --- eigenvectors -------------------------------------------------------------------------------------------------


def wide(value: int) -> np.longdouble:
    """An integer of any size in extended precision."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - int(high)))


def _refined(a: np.ndarray, x: np.ndarray, size: np.longdouble) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.longdouble]:
    """One step for all eigenvectors of ``a`` at once: (better vectors, eigenvalues, which pairs are too close, largest correction)."""
    residue = np.eye(x.shape[1], dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(residue))
    reach = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + size * np.linalg.norm(residue.astype(float)))
    gaps = values[None, :] - values[:, None]
    close = np.abs(gaps) <= reach
    step = np.where(close, residue / 2, (s + values[None, :] * residue) / np.where(close, WIDE(1), gaps))
    return x + x @ step, values, close, np.abs(step).max()


def _clusters(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Index runs, in order of the eigenvalues, whose neighbours are too close to tell apart."""
    order = np.argsort(values)
    joined = close[order[1:], order[:-1]]
    runs = np.split(order, np.flatnonzero(~joined) + 1)
    return [run for run in runs if len(run) > 1]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision.

    Single-precision eigenvectors are corrected by matrix products (Ogita and Aishima); where eigenvalues lie
    closer together than the present error, the vectors of the cluster are turned by the eigenvectors of the small
    shifted matrix ``Xj' (A - mu I) Xj``. Equal eigenvalues get some orthonormal basis. The largest entry of a vector is positive.
    """
    a = np.asarray(a, WIDE)
    size = np.abs(a).sum(axis=1).max()
    if not size:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / size
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start.astype(WIDE)
    least = WIDE(np.inf)
    for _ in range(ROUNDS):
        x, values, close, change = _refined(a, x, WIDE(1))
        if change < 1e-18 or (change < 1e-15 and change >= least):  # no step makes it better
            break
        for run in _clusters(values, close):
            own = x[:, run]
            shift = values[run].mean()
            small = own.T @ (a @ own - shift * own)
            small = (small + small.T) / 2
            scale = np.abs(small).max()
            if scale:
                _, turn = np.linalg.eigh((small / scale).astype(float))
                x[:, run] = own @ turn.astype(WIDE)
        least = min(least, change)
    for _ in range(2):  # what is left between vectors of almost equal eigenvalues
        x = x + x @ (np.eye(len(a), dtype=WIDE) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * size
    return values, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])


# --- exact sums ---------------------------------------------------------------------------------------------------


@dataclass
class Grid:
    """How vectors become integers: floor(scale * entry) + offset, in ``dim`` dimensions."""

    dim: int
    scale: float
    offset: int

    def blocks(self, batches, column: int = 0):
        """(batch, first row, integer vectors) of at most BLOCK_ROWS rows."""
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.column(column).slice(start, BLOCK_ROWS)
                values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), self.dim)
                with np.errstate(over="ignore"):
                    grid = np.floor(values * self.scale)
                yield batch, start, np.clip(grid, -MOST, MOST).astype(np.int64) + self.offset


def _cells(values: dict[int, int], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(values), pa.int32()), pa.array([Decimal(v) for v in values.values()], target.field(1).type)], schema=target)


def _summed(vectors: DataFrame, work, schema: str = "cell int, value decimal(38,0)") -> dict:
    """Sums by cell of what ``work`` yields for each task; as many rows as cells reach the driver."""
    target = arrow_schema(schema)
    made = map_arrow(vectors, lambda batches: work(batches, target), schema)
    return {row.cell: row.value for row in made.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def sums(vectors: DataFrame, grid: Grid) -> tuple[int, list[int]]:
    """How many vectors there are, and their sum in every dimension; exact."""

    def work(batches, target):
        n, total = 0, np.zeros(grid.dim, object)
        for _, _, x in grid.blocks(batches):
            n += len(x)
            high, low = x >> 26, x & ((1 << 26) - 1)
            total += high.sum(axis=0).astype(object) * (1 << 26) + low.sum(axis=0).astype(object)
        if n:
            yield _cells({grid.dim: n} | {i: int(v) for i, v in enumerate(total)}, target)

    found = _summed(vectors, work)
    return int(found.get(grid.dim, 0)), [int(found.get(i, 0)) for i in range(grid.dim)]


def products(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers, exact, as Python integers: matrix products of limbs that double precision holds exactly."""
    sign, size = np.sign(y), np.abs(y)
    limbs = [sign * (size >> s & ((1 << LIMB_BITS) - 1)) for s in range(0, max(1, int(size.max(initial=0)).bit_length()), LIMB_BITS)]
    limbs = [limb.astype(np.float64) for limb in limbs]
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, one in enumerate(limbs):
        for j, other in enumerate(limbs):
            out += (one.T @ other).astype(np.int64).astype(object) * (1 << LIMB_BITS * (i + j))
    return out


def second_moments(vectors: DataFrame, grid: Grid, centre: list[int]) -> list[list[int]]:
    """Sums of the products of two dimensions' distances from ``centre``; exact."""
    upper = [(i, j) for i in range(grid.dim) for j in range(i, grid.dim)]
    middle = np.array(centre, np.int64)

    def work(batches, target):
        total = None
        for _, _, x in grid.blocks(batches):
            made = products(x - middle)
            total = made if total is None else total + made
        if total is not None:
            yield _cells({i * grid.dim + j: int(total[i, j]) for i, j in upper}, target)

    found = _summed(vectors, work)
    return [[int(found.get(min(i, j) * grid.dim + max(i, j), 0)) for j in range(grid.dim)] for i in range(grid.dim)]


# --- the operator -------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted model; ``vectors`` has a unit eigenvector in every row."""

    grid: Grid
    n: int
    totals: list[int]
    centre: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: np.longdouble
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> list[np.ndarray]:
        """n * x - S, as 64-bit integers if those hold it and its squares' sum, else as Python integers."""
        rest = np.array([s - self.n * c for s, c in zip(self.totals, self.centre, strict=True)], object)
        y = x - np.array(self.centre, np.int64)
        bound = self.n * int(np.abs(y).max(initial=0)) + int(max(abs(rest), default=0))
        if bound * bound * max(1, self.grid.dim) < 1 << 62:
            return y * self.n - rest.astype(np.int64)
        return y.astype(object) * self.n - rest

    def project(self, far: np.ndarray) -> np.ndarray:
        """Whitened components of rows n * x - S."""
        return (far.astype(np.float64) / self.n) @ self.vectors.T.astype(np.float64) / np.sqrt(self.values.astype(np.float64))


def usable(vectors: DataFrame, vec_col: str, dim: int | None = None) -> DataFrame:
    """Rows whose vector is not null or empty and has finite entries only; of the most frequent length (ties: the longest)."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    found = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda c: F.coalesce(entry(c), F.lit(False))))
    return found if dim is None else found.filter(F.size(vec_col) == dim)


def fit(vectors: DataFrame, vec_col: str = "embedding", *, scale: float = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors, or None if there is none.

    Sums and second moments are integers and exact: every vector is centred on the rounded mean before its entries
    are multiplied, and what the rounding leaves is taken off exactly. The driver gets one number per pair of dimensions.
    Components whose eigenvalue is zero, as far as precision tells, are left out.
    """
    lengths = usable(vectors, vec_col).groupBy(F.size(vec_col).alias("dim")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    if top is None:
        return None
    grid = Grid(top.dim, scale, offset)
    chosen = usable(vectors, vec_col, grid.dim).select(vec_col)
    n, totals = sums(chosen, grid)
    centre = [(2 * s + n) // (2 * n) for s in totals]
    rest = [s - n * c for s, c in zip(totals, centre, strict=True)]
    moments = second_moments(chosen, grid, centre)
    square = wide(n) * wide(n)
    covariance = np.array([[wide(n * moments[i][j] - rest[i] * rest[j]) / square for j in range(grid.dim)] for i in range(grid.dim)], WIDE)
    values, found = eigenvectors(covariance)
    trace = np.trace(covariance)
    kept = int((values > trace * WIDE(1e-15) * grid.dim).sum())
    kept = min(kept, components)
    model = Whitening(grid, n, totals, centre, values[:kept], found.T[:kept], trace)
    model.identity_error = _identity_error(chosen, model)
    return model


def _identity_error(chosen: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, by a pass over all of them."""
    k = len(model.values)
    if not k:
        return 0.0

    def work(batches, target):
        total, products_ = np.zeros(k), np.zeros((k, k))
        for _, _, x in model.grid.blocks(batches):
            made = model.project(model.deviations(x))
            total += made.sum(axis=0)
            products_ += made.T @ made
        flat = np.r_[total, products_.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], schema=target)

    found = _summed(chosen, work, "cell int, value double")
    flat = np.array([found[i] for i in range(k + k * k)]) / model.n
    mean, moment = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(moment - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of squares of n * x - S, null if 64 bits don't hold it. Vectors that are null, empty,
    hold null or non-finite entries, or differ in length from the fitted ones give no row; nor do any without a model.
    Repeated ids are rows of their own, a null id stays null. Entries beyond 2**51 / scale count as that.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    target = arrow_schema(schema)
    explained = (model.values / model.trace).astype(np.float64)
    k = len(explained)

    def run(batches):
        for batch, start, x in model.grid.blocks(batches, 1):
            far = model.deviations(x)
            squares = (far * far).sum(axis=1)
            exact = pa.array([v if v < 1 << 63 else None for v in map(int, squares)] if far.dtype == object else squares, pa.int64())
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).slice(start, len(x)).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), model.n, np.int64)), exact.take(pa.array(rows)), pa.array(model.project(far).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    place = fresh_name(vectors, "_vector")
    chosen = usable(vectors, vec_col, model.grid.dim).select(F.col(id_col), F.col(vec_col).alias(place))
    return map_arrow(chosen, run, schema)
