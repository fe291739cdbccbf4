"""Import, gap fill and streaming import."""

import json

import pytest
from test_parsers import write_csv

from tracewright.plans import ingest as I
from tracewright.sources import parsers as P
from tracewright.sources.results import write_events_jsonl
from tracewright.streaming.ingest import start_ingest, stream_events


def prefetch_rows(n):
    return [{"ExecutableName": f"A{i}.EXE", "LastRun": f"2024-01-01 00:00:{i:02}"} for i in range(n)]


def test_resume_and_refusal(spark, tmp_path):
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(5) + [{"LastRun": "unreadable"}])
    store = str(tmp_path / "store")
    first = I.import_source(spark, store, "C", "pecmd", path, max_rows=2)
    assert (first["status"], first["inserted"], first["last_source_row"]) == ("PARTIAL", 2, 3)
    rest = I.import_source(spark, store, "C", "pecmd", path)
    assert (rest["status"], rest["inserted"], rest["rejected"], rest["duplicates"]) == ("COMPLETED", 3, 1, 0)
    assert I.read_events(spark, store).count() == 5
    with pytest.raises(I.ImportRefused, match="completed"):
        I.import_source(spark, store, "C", "pecmd", path)
    write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(6))
    with pytest.raises(I.ImportRefused, match="changed"):
        I.import_source(spark, store, "C", "pecmd", path)
    assert [r["status"] for r in I.read_ledger(spark, store).orderBy("updated_at").collect()] == ["PARTIAL", "COMPLETED"]


def test_gap_fill(spark, tmp_path):
    path = write_csv(tmp_path / "lnk.csv", P.REQUIRED["lecmd"], [{"SourceFile": "a", "TargetCreated": "2024-01-01 00:00:00"}])
    store = str(tmp_path / "store")
    states = lambda: {r["tool"]: (r["state"], r["inserted"]) for r in I.gap_fill(spark, store, "C", {"lecmd": path}).collect()}
    assert states() == {"recmd": ("SKIPPED_NO_SOURCE", 0), "lecmd": ("COMPLETED_MISSING_EVENTS", 1), "hayabusa": ("SKIPPED_NO_SOURCE", 0)}
    assert states()["lecmd"] == ("ALREADY_COMPLETE", 0)


def test_gap_fill_reads_its_source_once(spark, tmp_path, monkeypatch):
    """The import rules are checked on the written batch, not by reading and parsing the source once more."""
    path = write_csv(tmp_path / "lnk.csv", P.REQUIRED["lecmd"], [{"SourceFile": "a", "TargetCreated": "2024-01-01 00:00:00"}])
    plans, check = [], I.checked
    monkeypatch.setattr(I, "checked", lambda events, *rest: plans.append(events._jdf.queryExecution().optimizedPlan().toString()) or check(events, *rest))
    assert I.gap_fill(spark, str(tmp_path / "store"), "C", {"lecmd": path}).count() == 3
    assert plans and not any("MapInArrow" in plan or "Project" in plan for plan in plans)


def test_checked(spark, tmp_path):
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(1))
    events = P.prefetch_events(spark, path, "C")
    with pytest.raises(I.InvalidEvents, match="wrong_case"):
        I.checked(events, "OTHER")
    with pytest.raises(I.InvalidEvents, match="early_row"):
        I.checked(events, "C", "pecmd", start_row=3)


def test_stream_equals_batch(spark, tmp_path):
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(8))
    events = P.prefetch_events(spark, path, "C", parser_output="p")
    incoming = tmp_path / "in"
    for name in ("a", "b"):
        write_events_jsonl(events, str(incoming / name))
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    run = lambda: start_ingest(stream_events(spark, f"{incoming}/*", files_per_trigger=1), store, state, once=True).awaitTermination()
    run()
    want = sorted(r["event_uid"] for r in events.collect())
    assert sorted(r["event_uid"] for r in I.read_events(spark, store).collect()) == want
    # far later duplicates are dropped by the stored keys, not by the watermark state
    write_events_jsonl(events, str(incoming / "c"))
    run()
    got = I.read_events(spark, store)
    assert sorted(r["event_uid"] for r in got.collect()) == want
    row = got.first()
    assert row["provenance"]["parser"] == "pecmd" and json.loads(json.dumps(row["attributes"]))["run_timestamp_field"] == "LastRun"


def test_every_line_is_stored_or_rejected(spark, tmp_path):
    lines = ['{"Timestamp": "2024-01-01 00:00:00", "RuleTitle": "r"}', "{broken", "", '{"Timestamp": "never"}', '{"Timestamp": "2024-01-02 00:00:00"}']
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(lines))
    store = str(tmp_path / "store")
    got = I.import_source(spark, store, "C", "hayabusa", str(path))
    assert (got["inserted"], got["rejected"], got["malformed"], got["duplicates"]) == (2, 1, 1, 0)
    assert sorted((r["reason"], r["source_row"]) for r in I.read_rejects(spark, store).collect()) == [("malformed JSON", 2), ("unreadable time", 4)]


def test_fingerprint_tells_content_order_and_line_ends(spark, tmp_path):
    seen = set()
    for i, data in enumerate([b"a\nb\n", b"a\nb", b"b\na\n", b"a\r\nb\n", b"", b"\n", b"a\nc\n"]):
        (tmp_path / f"f{i}").write_bytes(data)
        seen.add(I.source_fingerprint(spark, str(tmp_path / f"f{i}"))["sha256"])
    assert len(seen) == 7
    (tmp_path / "same").write_bytes(b"a\nb\n")
    assert I.source_fingerprint(spark, str(tmp_path / "same"))["sha256"] in seen


def test_store_reads_are_pruned(spark, tmp_path):
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(3))
    store = str(tmp_path / "store")
    I.import_source(spark, store, "C", "pecmd", path)
    stored = I.read_events(spark, store)
    plan = I.stored_alike(stored, stored)._jdf.queryExecution().executedPlan().toString()
    folders, pushed = (plan.split(f"{kind}: [")[1].split("], ")[0] for kind in ("PartitionFilters", "PushedFilters"))
    assert "case_id" in folders and "source_tool" in folders and "GreaterThanOrEqual(event_ts" in pushed


def test_rejected_lines_are_not_read_again(spark, tmp_path):
    good = '{"Timestamp": "2024-01-01 00:00:00", "RuleTitle": "r"}'
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join([good, "{broken", "{cut", good.replace("01-01", "01-02"), "{last"]))
    store = str(tmp_path / "store")
    got = [I.import_source(spark, store, "C", "hayabusa", str(path), max_rows=n) for n in (3, 3)] + [I.import_source(spark, store, "C", "hayabusa", str(path))]
    assert [(g["inserted"], g["malformed"], g["last_source_row"]) for g in got] == [(1, 2, 3), (0, 0, 3), (1, 1, 5)]
    assert sorted(r["source_row"] for r in I.read_rejects(spark, store).collect()) == [2, 3, 5]
    commits = [(r["first_row"], r["last_row"], r["events"], r["rejects"]) for r in I.read_commits(spark, store).orderBy("committed_at").collect()]
    assert commits == [(1, 3, 1, 2), (4, 3, 0, 0), (4, 5, 1, 1)]


@pytest.mark.parametrize("step", ["commit_batch", "createDataFrame"])
def test_killed_between_write_and_ledger(spark, tmp_path, monkeypatch, step):
    """An import that dies before its commit leaves nothing to read; one that dies before its ledger row gives the same rows again."""
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(6) + [{"LastRun": "unreadable"}])
    store = str(tmp_path / "store")
    I.import_source(spark, store, "C", "pecmd", path, max_rows=2)
    before = I.read_events(spark, store).count()

    class Killed(Exception):
        pass

    def die(*_, **__):
        raise Killed

    with monkeypatch.context() as patch:
        if step == "commit_batch":
            patch.setattr(I, step, die)
        else:
            patch.setattr(I, "commit_batch", lambda *a, f=I.commit_batch, **b: (f(*a, **b), die()))
        with pytest.raises(Killed):
            I.import_source(spark, store, "C", "pecmd", path)
    assert I.read_events(spark, store).count() == (before if step == "commit_batch" else 6)
    assert I.read_rejects(spark, store).count() == (step != "commit_batch")
    got = I.import_source(spark, store, "C", "pecmd", path)
    assert (got["inserted"], got["rejected"]) == (4, 1)
    assert I.read_events(spark, store).select("event_uid").distinct().count() == I.read_events(spark, store).count() == 6
    assert I.read_rejects(spark, store).count() == 1


def test_compaction(spark, tmp_path):
    incoming, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], prefetch_rows(12) + [{"LastRun": "unreadable"}])
    events = P.prefetch_events(spark, path, "C", parser_output="p")
    for i in range(4):
        write_events_jsonl(events.filter(f"provenance.source_row % 4 = {i}").coalesce(1), str(incoming / f"p{i}"))
    stream = lambda where: start_ingest(stream_events(spark, f"{incoming}/*", files_per_trigger=1), store, where, once=True, compact_from=4)
    stream(state).awaitTermination()
    live = I.live_batches(spark, store)
    assert len(live) < 4 and any(name.startswith("compact-") for name in live)
    assert sorted(r["event_uid"] for r in I.read_events(spark, store).collect()) == sorted(r["event_uid"] for r in events.filter("event_ts is not null").collect())
    assert I.read_rejects(spark, store).count() == 1
    # Another stream over the same files finds everything stored.
    stream(str(tmp_path / "other")).awaitTermination()
    assert I.read_events(spark, store).count() == 12
    name = I.compact(spark, store, least_batches=2)
    assert I.live_batches(spark, store) == [name] and I.read_events(spark, store).count() == 12
    assert len(I.read_events(spark, store).inputFiles()) >= 1
    assert I.compact(spark, store, least_batches=2) is None
