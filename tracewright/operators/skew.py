"""Joins and rankings that survive one key holding a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import FILE_FACTOR

# At most this many keys can be treated as hot. Any key outside the largest
# MAX_HOT_KEYS holds less than 1/MAX_HOT_KEYS of the rows, so the hot-key table
# has a fixed size bound and may always be broadcast.
MAX_HOT_KEYS = 1024
ROWS_PER_SALT = 200_000
MAX_SALTS = 512
SMALL_BYTES = 32 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate; file scans give their real size."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(planned / float(df.sparkSession.conf.get(FILE_FACTOR)))


def hot_keys(df: DataFrame, on: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The largest keys above ``rows_per_salt`` rows with their salt count.

    The count combines on the map side; the result has at most MAX_HOT_KEYS
    rows.
    """
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
        .orderBy(F.desc("_n"), *on)
        .limit(MAX_HOT_KEYS)
        .select(
            *on,
            F.least(F.ceil(F.col("_n") / rows_per_salt), F.lit(MAX_SALTS))
            .cast("int")
            .alias("_salts"),
        )
    )


def salted_join(
    big: DataFrame,
    other: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    salt_by: list[str],
    hot_on: list[str] | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    big_rows: int | None = None,
    min_bytes: int = SMALL_BYTES,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join where rows of a hot key in ``big`` spread over many tasks.

    The hot keys (at most MAX_HOT_KEYS rows) are counted first; without any,
    this is a plain join. Otherwise each row of ``big`` lands in exactly one
    salt and meets every row of ``other`` with its key there, so inner, left,
    semi and anti joins give the same rows as an unsalted join. ``salt_by``
    must tell rows of one key apart; hashing it keeps the salt the same when a
    lost task runs again. ``hot_on`` is a subset of ``on`` to look for hot keys
    by, where that is cheaper to count than the full key. ``counted`` holds the
    keys of ``big`` where they are cheaper to read. ``big_rows`` is the
    row count where the caller knows it. Inputs too small to hold a hot key
    (by rows, or by the planner's size estimate) skip the count.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    known_small = big_rows is not None and big_rows <= rows_per_salt
    if known_small or planned_bytes(big) <= min_bytes:
        return big.join(other, on, how)
    heavy = hot_on or on
    counted = big if counted is None else counted
    if _hashes_alike(big, other, heavy):
        # Counted by a hash of the key, as long keys are costly to move; keys that share a hash share their salts, which joins them all the same.
        filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in heavy])
        slot = F.when(filled, F.xxhash64(*heavy))
        big, other, counted, heavy = (*(df.withColumn("_slot", slot) for df in (big, other, counted)), ["_slot"])
    found = hot_keys(counted.select(*heavy), heavy, rows_per_salt)
    rows = found.collect()
    if heavy == ["_slot"] and not rows:
        big, other = big.drop("_slot"), other.drop("_slot")
    if not rows:
        return big.join(other, on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(rows, found.schema))
    slot = F.xxhash64(*[F.col(c) for c in salt_by])
    salt = F.coalesce(F.pmod(slot, F.col("_salts")), F.lit(0)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    left = big.join(hot, heavy, "left").withColumn("_salt", salt).drop("_salts", "_slot")
    right = other.join(hot, heavy, "left").withColumn("_salt", copies).drop("_salts", "_slot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def parted_join(
    left: DataFrame, right: DataFrame, on: list[str], *, left_by: list[str], right_by: list[str], left_rows: int, right_rows: int
) -> DataFrame:
    """Inner equi-join where a hot key is cut into parts of about ``left_rows`` and ``right_rows`` rows on both sides.

    Each pair of parts is a group of the join, so a task holds one part of ``right`` at a time, and a row of ``left`` meets its part row
    by row. A row is copied once per part of the other side. Hot keys are counted first, at most MAX_HOT_KEYS on each side;
    ``left_by`` and ``right_by`` tell the rows of a key apart.
    """
    counts = [hot_keys(df.select(*on), on, n).withColumnRenamed("_salts", c) for df, n, c in ((left, left_rows, "_lefts"), (right, right_rows, "_rights"))]
    found = counts[0].join(counts[1], on, "full")
    rows = found.collect()
    if not rows:
        return left.join(right, on)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, found.schema))

    def dealt(df: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
        parts, copies = (F.coalesce(F.col(f"{c}s"), F.lit(1)) for c in (own, other))
        made = df.join(hot, on, "left").withColumn(own, F.pmod(F.xxhash64(*by), parts).cast("int"))
        return made.withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1))).drop(f"{own}s", f"{other}s")

    a, b = dealt(left, left_by, "_left", "_right"), dealt(right, right_by, "_right", "_left")
    # Merged, as only sorted groups keep the rows of a part together.
    return a.hint("merge").join(b, [*on, "_left", "_right"]).drop("_left", "_right")


def _hashes_alike(big: DataFrame, other: DataFrame, keys: list[str]) -> bool:
    """Whether the keys hold text and equal keys of both sides have the same hash."""
    left, right = dict(big.dtypes), dict(other.dtypes)
    kinds = {left[c] for c in keys}
    return "string" in kinds and kinds <= {"string", "int", "bigint", "date", "timestamp"} and all(left[c] == right.get(c) for c in keys)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group.

    ``row_number() <= n`` is turned into a per-task limit before the shuffle,
    so a hot group sends at most ``n`` rows per map task. Above the planner's
    threshold for that rule the same is done here in two steps.
    """
    name = rank or "_rank"
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        slots = [F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(256))]
        inner = Window.partitionBy(*by, *slots).orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(inner)).filter(F.col("_pre") <= n).drop("_pre")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def _hashable(df: DataFrame, column: str) -> bool:
    return "map<" not in dict(df.dtypes)[column]


def first_by(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """One whole row per group, the first in ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*keys)).alias("_row"))
        .select(*by, "_row.*")
    )


def last_by(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """One whole row per group, the last in ``order``."""
    rest = [c for c in df.columns if c not in by]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    return (
        df.groupBy(*by)
        .agg(F.max_by(F.struct(*rest), F.struct(*keys)).alias("_row"))
        .select(*by, "_row.*")
    )
