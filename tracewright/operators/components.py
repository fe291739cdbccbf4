"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.skew import salted_join
from tracewright.session import cut_lineage

MAX_ROUNDS = 60
SEEDS = 4


def _point_at_smallest(arcs: DataFrame) -> DataFrame:
    """For arcs (node, peer): the smallest peer of each node."""
    return arcs.groupBy("node").agg(F.min("peer").alias("low"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hang every larger neighbour of a node under the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("peer").alias("node"), F.col("node").alias("peer")))
    low = _point_at_smallest(both).withColumn("low", F.least("low", "node"))
    larger = both.filter(F.col("peer") > F.col("node"))
    return (
        salted_join(larger, low, ["node"], salt_by=["peer"], big_rows=rows)
        .select(F.col("peer").alias("node"), F.col("low").alias("peer"))
        .distinct()
    )


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hang a node and its smaller neighbours under the smallest of them."""
    down = edges.select(
        F.greatest("node", "peer").alias("node"), F.least("node", "peer").alias("peer")
    )
    low = _point_at_smallest(down)
    moved = (
        salted_join(down, low, ["node"], salt_by=["peer"], big_rows=rows)
        .filter(F.col("peer") != F.col("low"))
        .select(F.col("peer").alias("node"), F.col("low").alias("peer"))
    )
    return moved.unionByName(low.select("node", F.col("low").alias("peer"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("node", "peer").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(
    edges: DataFrame, src: str, dst: str, *, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(node, component) for every endpoint; the label is the smallest node.

    Rounds grow with the logarithm of the graph. Each round is written to the
    shared checkpoint folder, and the loop stops when the edge set is stable.
    Only one (count, checksum) row per round reaches the driver. Self loops
    keep their node as its own component.

    Text nodes go through the rounds as 64-bit hashes, once these are known to differ for all nodes: rounds move 16 bytes
    an edge, and only distinct nodes are moved with their text.
    """
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("peer"))
    if {kind for _, kind in pairs.dtypes} != {"string"}:
        return _contract(pairs, max_rounds)
    pairs = cut_lineage(pairs.filter(F.col("node").isNotNull() & F.col("peer").isNotNull()))  # read for the names and for the codes
    names = cut_lineage(pairs.select(F.explode(F.array("node", "peer")).alias("name")).distinct())
    code = _telling_code(names)
    if code is None:
        return _contract(pairs, max_rounds)
    coded = _contract(pairs.select(code("node").alias("node"), code("peer").alias("peer")), max_rounds)
    placed = cut_lineage(names.withColumn("node", code("name")).join(coded, "node").select("name", "component"))
    smallest = placed.groupBy("component").agg(F.min("name").alias("_smallest"))
    return salted_join(placed, smallest, ["component"], salt_by=["name"]).select(
        F.col("name").alias("node"), F.col("_smallest").alias("component")
    )


def _telling_code(names: DataFrame) -> Callable[[str], Column] | None:
    """A 64-bit hash that differs for all ``names``, of several seeds; none if all of them meet."""
    for seed in range(SEEDS):
        code = lambda name, seed=seed: _code(name, seed)
        if names.groupBy(code("name").alias("code")).count().filter("count > 1").isEmpty():
            return code
    return None


def _code(name: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def _contract(pairs: DataFrame, max_rounds: int) -> DataFrame:
    loops = pairs.filter(F.col("node") == F.col("peer")).select("node").distinct()
    current = cut_lineage(
        pairs.filter(F.col("node") != F.col("peer"))
        .select(F.greatest("node", "peer").alias("node"), F.least("node", "peer").alias("peer"))
        .distinct()
    )
    before = _state(current)
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current, 2 * before[0]), 2 * before[0]))
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = current.select(F.col("peer").alias("node"), F.col("peer").alias("component"))
    labelled = current.select("node", F.col("peer").alias("component")).unionByName(roots)
    lonely = loops.join(labelled, "node", "left_anti").select("node", F.col("node").alias("component"))
    return labelled.distinct().unionByName(lonely)
