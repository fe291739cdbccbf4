"""Generic operators against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators.components import connected_components
from tracewright.operators.interval import crowded_anchors, interval_join
from tracewright.operators.ranking import budget_prefix, number_rows
from tracewright.operators.sessions import assign_sessions, sessionize
from tracewright.operators.skew import first_by, hot_keys, salted_join, top_n


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    rng = random.Random(1)
    # one key holds a third of the rows, some keys are NULL
    big = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "z"])) for i in range(600)]
    other = [("hot", 1), ("hot", 2), ("a", 3), ("q", 4)]
    left = spark.createDataFrame(big, "id long, k string")
    right = spark.createDataFrame(other, "k string, v long")
    plain = left.join(right, ["k"], how)
    salted = salted_join(left, right, ["k"], how, salt_by=["id"], rows_per_salt=50, min_bytes=0)
    columns = plain.columns
    assert "Salts" not in "".join(salted.columns)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert key(plain) == key(salted)
    hot = hot_keys(left, ["k"], 50).collect()
    assert hot and all(r["k"] is not None for r in hot)


def test_interval_join_boundaries_and_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.choice("xy"), rng.randrange(0, 6_000_000)) for i in range(120)]
    c = [(i, rng.choice("xy"), rng.randrange(0, 6_000_000)) for i in range(150)]
    a += [(1000, "e", 5_000_000)]
    c += [(1000, "e", 6_000_000), (1001, "e", 6_000_001), (1002, "e", 4_000_000), (1003, "e", -1)]
    left = spark.createDataFrame(a, "a long, k string, a_us long")
    right = spark.createDataFrame(c, "c long, k string, c_us long")
    got = rows_of(
        interval_join(left, right, ["k"], anchor_us="a_us", candidate_us="c_us", window_us=1_000_000, salt_by=["c"]).select("a", "c")
    )
    want = sorted((x[0], y[0]) for x in a for y in c if x[1] == y[1] and abs(x[2] - y[2]) <= 1_000_000)
    assert got == want
    assert (1000, 1000) in got and (1000, 1001) not in got


@pytest.mark.parametrize("limit", [3, 10, 40])
def test_crowded_anchors_brute_force(spark, limit):
    rng = random.Random(limit)
    events = [(i, rng.choice(["c1", "c2"]), rng.choice("pqr"), int(rng.gauss(5, 2) * 1_000_000) // 500_000 * 500_000) for i in range(300)]
    df = spark.createDataFrame(events, "uid long, g string, s string, us long")
    got = {r[0] for r in crowded_anchors(df, df, uid="uid", group="g", source="s", ts_us="us", window_us=1_000_000, limit=limit).collect()}
    want = {
        a[0] for a in events
        if sum(1 for e in events if e[1] == a[1] and e[2] != a[2] and abs(e[3] - a[3]) <= 1_000_000) > limit
    }
    assert got == want


def test_crowd_limit_is_exclusive(spark):
    events = [("a", "g", "p", 0)] + [(f"e{i}", "g", "q", 1_000_000) for i in range(5)] + [("far", "g", "q", 1_000_001)]
    df = spark.createDataFrame(events, "uid string, g string, s string, us long")
    anchors = df.filter("uid = 'a'")
    run = lambda n: crowded_anchors(anchors, df, uid="uid", group="g", source="s", ts_us="us", window_us=1_000_000, limit=n).count()
    assert run(5) == 0 and run(4) == 1


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {x: min(g) for g in groups.values() for x in g}


SHAPES = {
    "path": [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)],
    "star": [("hub", f"leaf{i}") for i in range(50)],
    "cycle": [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)],
    "two": [("a", "b"), ("c", "d"), ("a", "b"), ("b", "a")],
    "loop": [("x", "x"), ("y", "z")],
}


@pytest.mark.parametrize("shape", [*SHAPES, "random1", "random2"])
def test_components(spark, shape):
    if shape.startswith("random"):
        rng = random.Random(shape)
        edges = [(f"v{rng.randrange(80):02}", f"v{rng.randrange(80):02}") for _ in range(60)]
    else:
        edges = SHAPES[shape]
    df = spark.createDataFrame(edges, "a string, b string").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_sessions_gap_is_inclusive(spark):
    times = [("k", t) for t in (0, 900, 1801, 1801, 5000)] + [("j", 7)]
    df = spark.createDataFrame(times, "k string, us long")
    got = rows_of(sessionize(df, ["k"], "us", 900).select("k", "first_us", "last_us", "n"))
    assert got == [("j", 7, 7, 1), ("k", 0, 900, 2), ("k", 1801, 1801, 2), ("k", 5000, 5000, 1)]


def test_sessions_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-5_000, 60_000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, us long")
    want = {}
    for key in "ab":
        number, last = 0, None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last > 200:
                number += 1
            want[(key, t)] = number
            last = t
    got = {(r["k"], r["us"]): r["session_no"] for r in assign_sessions(df, ["k"], "us", 200).collect()}
    assert got == want


def test_number_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"]: r["n"] for r in number_rows(df, [F.desc("v"), F.asc("id")], "n").collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_budget_prefix(spark):
    rows = [("a", 1, 50), ("a", 2, 50), ("a", 3, 1), ("b", 1, 500), ("b", 2, 1), ("c", 1, 100), ("c", 2, 1)]
    df = spark.createDataFrame(rows, "g string, o long, c long")
    got = rows_of(budget_prefix(df, ["g"], [F.asc("o")], F.col("c"), 100).select("g", "o"))
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_top_n_above_planner_threshold(spark):
    df = spark.range(5000).select("id", F.lit("hot").alias("g"))
    got = [r["id"] for r in top_n(df, ["g"], [F.desc("id")], 1500).collect()]
    assert sorted(got) == list(range(3500, 5000))


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("g"))
    plan = top_n(df, ["g"], [F.desc("id")], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_by_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, o long, v string")
    assert rows_of(first_by(df, ["k"], ["o", "v"])) == [("a", 1, "y")]
