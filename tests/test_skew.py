"""The link and component plans with the salting path forced by a low threshold."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F
from test_operators import union_find
from test_plans import make_events

from tracewright.operators import components, interval, skew
from tracewright.plans import correlate as K


@pytest.fixture
def low_threshold(monkeypatch):
    forced = partial(skew.salted_join, rows_per_salt=5, min_bytes=-1)

    def call(*args, **kwargs):
        kwargs.pop("big_rows", None)
        return forced(*args, **kwargs)

    monkeypatch.setattr(interval, "salted_join", call)
    monkeypatch.setattr(components, "salted_join", call)


def pairs(spark):
    rows = [{"event_uid": f"a{i}", "source_tool": "pecmd", "at": 10 + i * 0.01, "executable": "HOT.EXE"} for i in range(6)]
    rows += [{"event_uid": f"m{i:02}", "source_tool": "mftecmd", "at": 10 + i * 0.02, "path": "C:\\x\\hot.exe"} for i in range(30)]
    events = make_events(spark, rows)
    matches = K.shared_key_matches(K.uncrowded_anchors(events), events, fanout=1000)
    return sorted((r["a_uid"], r["c_uid"], r["raw_score"]) for r in matches.collect())


def test_hot_cell_gives_the_same_pairs(spark, low_threshold):
    got = pairs(spark)
    assert len(got) == 6 * 30 and len(set(got)) == len(got)


def test_plain_plan_gives_the_same_pairs(spark):
    got = pairs(spark)
    assert len(got) == 6 * 30


def test_hub_component(spark, low_threshold):
    edges = [("hub", f"n{i:02}") for i in range(20)] + [("n03", "z1"), ("z1", "z2"), ("q1", "q2")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_edges_of_a_hub(spark):
    from tracewright.plans.lookups import incident_edges

    rng = random.Random(3)
    name = lambda: "hub" if rng.random() < 0.4 else f"e{rng.randrange(60)}"
    edges = [(f"x{i}", name(), name(), "R", 0.5, "HIGH", 1.0) for i in range(400)]
    held = [(f"f{i % 7}", name()) for i in range(60)] + [("f9", None)]
    want = sorted({(f, e[0]) for f, uid in held for e in edges if uid is not None and uid in e[1:3]})
    schema = "edge_uid string, event_uid_a string, event_uid_b string, relationship_type string, score double, confidence string, time_delta_seconds double"
    frames = spark.createDataFrame(edges, schema), spark.createDataFrame(held, "finding_id string, event_uid string")
    for options in ({}, {"rows_per_salt": 20, "min_bytes": 0}):
        got = [tuple(r) for r in incident_edges(*frames, **options).select("finding_id", "edge_uid").collect()]
        assert sorted(got) == want



def shuffled_rows(node):
    """Rows that the exchanges of an executed plan have written."""
    name = node.nodeName()
    inner = "executedPlan" if name == "AdaptiveSparkPlan" else "plan" if name.endswith("QueryStage") else None
    below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(map(shuffled_rows, below))


@pytest.mark.parametrize("listed", [3, 1000])
def test_edges_of_a_hub_in_every_finding(spark, monkeypatch, listed):
    """The rows of a hub, all findings times all its edges, are not shuffled to find repeats."""
    from tracewright.plans import lookups

    monkeypatch.setattr(lookups, "LISTED", listed, raising=False)
    rng = random.Random(5)
    edges = [(f"x{i}", "hub", f"e{rng.randrange(300)}", "R", 0.5, "HIGH", 1.0) for i in range(600)]
    held = [(f"f{i}", uid) for i in range(40) for uid in ("hub", *(f"e{rng.randrange(300)}" for _ in range(15)))]
    want = sorted({(f, e[0]) for f, uid in held for e in edges if uid in e[1:3]})
    schema = "edge_uid string, event_uid_a string, event_uid_b string, relationship_type string, score double, confidence string, time_delta_seconds double"
    frames = spark.createDataFrame(edges, schema), spark.createDataFrame(held, "finding_id string, event_uid string")
    found = lookups.incident_edges(*frames, rows_per_salt=100, min_bytes=0).select("finding_id", "edge_uid")
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 40 * 600
    assert listed < 1000 or shuffled_rows(found._jdf.queryExecution().executedPlan()) < len(want) / 2


def test_stored_keys_are_not_broadcast_by_their_file_size(spark):
    """Columns that compress to nothing let a table of keys look small; in memory it is over the limit for broadcasts."""
    from tracewright.session import cut_lineage, prepare

    prepare(spark)
    key = F.sha2(F.col("id").cast("string"), 256).alias("key")
    wide = [F.lit("a text that is the same in every row, and long").alias(f"c{i}") for i in range(8)]
    table = cut_lineage(spark.range(100_000).select(key, *wide))
    joined = table.join(table.select("key", F.col("c0").alias("other")), "key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert skew.planned_bytes(table) < 16 << 20  # as the files are


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_long_keys_are_counted_by_a_hash(spark, monkeypatch, how):
    """Hot keys are looked for by 8 bytes a row, and keys of one hash still find their own partners only."""
    seen, hash_of, found = [], F.xxhash64, skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, *rest: seen.append(df.dtypes) or found(df, *rest))
    monkeypatch.setattr(skew.F, "xxhash64", lambda *c: hash_of(F.length(*c)) if isinstance(c[0], str) else hash_of(*c))
    left = spark.createDataFrame([(i, None if i % 9 == 0 else f"k{i % 4}") for i in range(200)], "id long, k string")
    right = spark.createDataFrame([("k0", 1), ("k0", 2), ("k3", 3), (None, 4), ("q", 5)], "k string, v long")
    got = skew.salted_join(left, right, ["k"], how, salt_by=["id"], rows_per_salt=20, min_bytes=0)
    want = left.join(right, ["k"], how)
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and seen == [[("_slot", "bigint")]]


def test_parted_join_is_the_plain_join(spark):
    rng = random.Random(11)
    key = lambda: rng.choice([None, "hub", "hub", "side", f"k{rng.randrange(6)}"])
    left = spark.createDataFrame([(i, key()) for i in range(150)], "a long, k string")
    right = spark.createDataFrame([(i % 90, key()) for i in range(120)], "b long, k string")
    want = sorted(tuple(r) for r in left.join(right, ["k"]).collect())
    for rows in ((7, 11), (7, 10_000), (10_000, 7), (10_000, 10_000)):
        got = skew.parted_join(left, right, ["k"], left_by=["a"], right_by=["b"], left_rows=rows[0], right_rows=rows[1])
        assert got.columns == ["k", "a", "b"] and sorted(tuple(r) for r in got.collect()) == want


def test_rows_of_a_hub_are_small_when_written(spark, tmp_path):
    """With more findings than a dictionary of the file format takes, rows come in runs of few of them: their texts are not written again and again."""
    from tracewright.plans.lookups import incident_edges

    uid = lambda kind: F.sha2(F.concat(F.lit(kind), F.col("id").cast("string")), 256)
    edges = spark.range(128).select(
        uid("x").alias("edge_uid"), F.lit("hub").alias("event_uid_a"), uid("e").alias("event_uid_b"), F.lit("R").alias("relationship_type"),
        F.lit(0.5).alias("score"), F.lit("HIGH").alias("confidence"), F.lit(1.0).alias("time_delta_seconds"),
    )
    finding = uid("f").alias("finding_id")
    held = spark.range(24_000).select(finding, F.lit("hub").alias("event_uid")).unionByName(spark.range(100).select(finding, uid("e").alias("event_uid")))
    incident_edges(edges, held, rows_per_salt=200, min_bytes=0).select("finding_id", "edge_uid", "score").write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.distinct().count() == 24_000 * 128
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 24_000 * 128 * 3
