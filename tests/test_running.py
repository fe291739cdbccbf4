"""Running values, sessions without a key and progress per line."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.running import range_parts, running
from tracewright.operators.sessions import assign_sessions
from tracewright.plans import progress as G
from tracewright.streaming.progress import read_progress, start_line_progress, stream_lines


@pytest.fixture(autouse=True)
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_running_values(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([None, 1, 5, rng.randint(0, 999)])) for i in range(600)] + [(None, 1, 4), (None, 2, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for by in (["k"], []):
        parts = range_parts(df, by, ["i"] if by else ["i", "k"])
        assert parts.select("_part").distinct().count() > 4
        order = ["i"] if by else ["i", "k"]
        got = running(parts, by, order, high=("max", F.col("v")), total=("sum", F.col("v")))
        got = running(got, by, order, before=True, low=("max", F.col("v")))
        want, seen = [], {}
        for k, i, v in sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or "")):
            held = seen.setdefault(k if by else 0, [])
            low = max(held, default=None)
            if v is not None:
                held.append(v)
            want.append((k, i, max(held, default=None), sum(held) if held else None, low))
        assert sorted(map(tuple, got.select("k", "i", "high", "total", "low").collect()), key=repr) == sorted(want, key=repr)


def test_sessions_of_one_sequence(spark):
    rng = random.Random(2)
    times = sorted(rng.randint(0, 400_000) for _ in range(500)) + [400_900, 401_801]
    found = assign_sessions(spark.createDataFrame([(t,) for t in times], "us long"), [], "us", 900)
    want, number, last = [], 0, None
    for t in times:
        number += last is None or t - last > 900
        last = t
        want.append((t, number))
    assert sorted((r.us, r.session_no) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def plain(lines):
    out, reached = [], None
    for line in lines:
        if not line.strip():
            continue
        found = next((G.PHASES.index(p) for p, pattern in G.PHASE_PATTERNS.items() if __import__("re").search(pattern, line, 2)), None)
        started = found is not None and (reached is None or found > reached)
        reached = max((x for x in (found, reached) if x is not None), default=None)
        out.append((line, found, reached, started))
    return out


LINES = ["boot", "PARSING a", "", "note", "normalization", "parsing again", "CORRELATION", " ", "end", "Final report", "RAG"]


def test_line_progress(spark):
    rows = [("one", i, line) for i, line in enumerate(LINES * 40)] + [("two", i, line) for i, line in enumerate(LINES[5:])]
    df = spark.createDataFrame(rows, "case_id string, i int, line string").repartition(5)
    got = G.line_progress(df, ["i"])
    by_case = {"one": [], "two": []}
    for r in sorted(got.collect(), key=lambda r: r.i):
        by_case[r.case_id].append((r.line, r.detected, r.phase_index, r.started))
    assert by_case == {"one": plain(LINES * 40), "two": plain(LINES[5:])}
    assert got.filter("phase = 'Final Report'").first().percent == 100.0
    assert G.line_progress(df.limit(0), ["i"]).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    logs, table, state = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "state")
    (logs / "c1").mkdir(parents=True)
    (logs / "c1" / "a.log").write_text("\n".join(LINES[:6]) + "\n")
    run = lambda: start_line_progress(stream_lines(spark, str(logs)), table, state, once=True).awaitTermination()
    assert read_progress(spark, table).count() == 0
    run()
    (logs / "c1" / "b.log").write_text("\n".join(LINES[6:]) + "\n")
    run()
    got = [(r.line, r.detected, r.phase_index, r.started) for r in sorted(read_progress(spark, table).collect(), key=lambda r: (r.file, r.position))]
    assert got == plain(LINES)
    run()
    assert read_progress(spark, table).count() == len(got)


def test_packages_of_a_hub_finding(spark, tmp_path):
    from tracewright.plans.context import package_parts, read_packages, write_packages

    rows = [(1, "hub", "evidence", f"{i:05}", "x" * (i % 40)) for i in range(800)] + [(2, "small", "finding", "", "{}"), (2, "small", "evidence", "a", "é")]
    items = spark.createDataFrame(rows, "priority long, finding_id string, section string, sort_key string, item string")
    parts = package_parts(items, part_bytes=500).collect()
    assert all(r.bytes < 540 for r in parts)
    hub = sorted((r for r in parts if r.finding_id == "hub"), key=lambda r: r.part)
    assert [i.sort_key for r in hub for i in r["items"]] == [f"{i:05}" for i in range(800)] and len(hub) == hub[-1].part > 20
    write_packages(items, str(tmp_path / "out"))
    packages, index = read_packages(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in index.collect()) == [(1, "hub", 1, sum(i % 40 for i in range(800)), 800, 800, 0), (2, "small", 1, 4, 2, 1, 0)]
    assert packages.count() == 2
