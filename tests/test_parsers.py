"""Parser adapters on small written files."""

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.plans import acquisition as A
from tracewright.sources import inventory as I
from tracewright.sources import parsers as P
from tracewright.sources.results import read_results


def write_csv(path, header, rows, bom=True):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as handle:
        writer = csv.DictWriter(handle, header, restval="")
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def test_log_rows(spark, tmp_path):
    header = P.REQUIRED["evtxecmd"] + ["PayloadData1", "PayloadData3", "ExecutableInfo"]
    rows = [
        {"TimeCreated": "2024-01-01 10:00:00.1234567", "EventId": "7045", "Payload": 'two\nlines, "quoted"', "PayloadData1": " a ", "PayloadData3": "ü"},
        {"TimeCreated": " ", "EventId": "1"},
        {"TimeCreated": "2024-01-01T10:00:00+02:00", "Computer": " H "},
        {"TimeCreated": "not a time"},
    ]
    path = write_csv(tmp_path / "evtx.csv", header, rows)
    events = P.log_events(spark, path, "CASE-1", parser_output="out.csv")
    got = {r["provenance"]["source_row"]: r for r in events.collect()}
    assert sorted(got) == [2, 4, 5]
    assert got[2]["attributes"]["payload"] == 'two\nlines, "quoted"'
    assert json.loads(got[2]["attributes"]["payload_data"]) == {"PayloadData1": "a", "PayloadData3": "ü"}
    assert got[2]["description"] == "Windows Event ID 7045" and got[4]["description"] == "Windows event"
    assert str(got[2]["event_ts"]) == "2024-01-01 10:00:00.123456" and str(got[4]["event_ts"]) == "2024-01-01 08:00:00"
    identity = "CASE-1|evtxecmd|out.csv|2|EVENT_CREATED|2024-01-01 10:00:00.1234567|WINDOWS_EVENT"
    assert got[2]["event_uid"] == hashlib.sha256(identity.encode()).hexdigest()
    good, bad = P.split_unparseable(events)
    assert good.count() == 2 and bad.count() == 1


def test_files_with_other_headers(spark, tmp_path):
    row = {"SourceFilename": "s", "ExecutableName": "A.EXE", "LastRun": "2024-01-01 00:00:00"}
    first = write_csv(tmp_path / "a.csv", P.REQUIRED["pecmd"], [row])
    second = write_csv(tmp_path / "b c.csv", P.REQUIRED["pecmd"][::-1] + ["Note"], [{**row, "ExecutableName": "B.EXE", "Note": "n"}])
    (tmp_path / "empty.csv").write_text("")
    got = P.prefetch_events(spark, [first, second, str(tmp_path / "empty.csv")], "C").collect()
    assert sorted((r["executable"], r["timestamp"]) for r in got) == [("A.EXE", row["LastRun"]), ("B.EXE", row["LastRun"])]
    bad = write_csv(tmp_path / "d.csv", P.REQUIRED["pecmd"][1:], [{"LastRun": "2024-01-01"}])
    with pytest.raises(P.MissingColumns, match="SourceFilename"):
        P.prefetch_events(spark, [first, bad], "C")


def test_missing_header(spark, tmp_path):
    path = write_csv(tmp_path / "x.csv", ["TimeCreated"], [{"TimeCreated": "2024-01-01"}])
    with pytest.raises(P.MissingColumns, match="EventId"):
        P.log_events(spark, path, "C")


def test_file_table_unpivot(spark, tmp_path):
    header = P.REQUIRED["mftecmd"] + ["SI<FN", "Extension"]
    row = {"ParentPath": ".\\a", "FileName": "b.txt", "Created0x10": "2024-01-01 00:00:00", "LastAccess0x30": "2024-01-02 00:00:00", "SI<FN": "True", "EntryNumber": "5"}
    path = write_csv(tmp_path / "mft.csv", header, [row, {"FileName": "none"}])
    got = sorted(P.mft_events(spark, path, "C", parser_output="m").collect(), key=lambda r: r["timestamp"])
    assert [(r["event_type"], r["timestamp_source"], r["path"], r["mft_entry"]) for r in got] == [
        ("FILE_CREATED", "MFT.Created0x10", ".\\a\\b.txt", "5"), ("FILE_ACCESSED", "MFT.LastAccess0x30", ".\\a\\b.txt", "5"),
    ]
    assert got[0]["attributes"]["si_less_than_fn"] == "True"
    assert got[0]["description"] == "FILE_CREATED timestamp from STANDARD_INFORMATION"


def test_prefetch_equal_times_are_distinct_runs(spark, tmp_path):
    row = {"ExecutableName": "A.EXE", "LastRun": "2024-01-01 00:00:00", "PreviousRun0": "2024-01-01 00:00:00"}
    path = write_csv(tmp_path / "pf.csv", P.REQUIRED["pecmd"], [row])
    got = P.prefetch_events(spark, path, "C", parser_output="p")
    assert got.select("event_uid").distinct().count() == 2
    identity = "C|pecmd|p|2|EXECUTION_TIME|2024-01-01 00:00:00|PROGRAM_EXECUTION|PreviousRun0"
    assert hashlib.sha256(identity.encode()).hexdigest() in {r["event_uid"] for r in got.collect()}


def test_registry_many_files(spark, tmp_path):
    for name, count in (("a", 3), ("b", 2)):
        rows = [{"HiveType": "SYSTEM", "KeyPath": f"{name}{i}", "LastWriteTimestamp": "2024-01-01 00:00:00"} for i in range(count)]
        write_csv(tmp_path / f"recmd_{name}.csv", P.REQUIRED["recmd"], rows)
    got = P.registry_events(spark, [str(tmp_path / "recmd_a.csv"), str(tmp_path / "recmd_b.csv")], "C")
    rows = sorted((r["provenance"]["parser_output"].rsplit("/", 1)[1], r["provenance"]["source_row"], r["registry_key"]) for r in got.collect())
    assert rows == [
        ("recmd_a.csv", 2, "a0"), ("recmd_a.csv", 3, "a1"), ("recmd_a.csv", 4, "a2"), ("recmd_b.csv", 2, "b0"), ("recmd_b.csv", 3, "b1"),
    ]


def test_shortcut_target(spark, tmp_path):
    rows = [
        {"SourceFile": "s.lnk", "LocalPath": " ", "RelativePath": "..\\x.exe", "TargetCreated": "2024-01-01 00:00:00"},
        {"SourceFile": "t.lnk", "LocalPath": "C:\\y.exe", "RelativePath": "z", "SourceModified": "2024-01-01 00:00:00"},
    ]
    path = write_csv(tmp_path / "lnk.csv", P.REQUIRED["lecmd"], rows)
    got = sorted((r["path"], r["target_path"], r["event_type"]) for r in P.shortcut_events(spark, path, "C").collect())
    assert got == [("s.lnk", "..\\x.exe", "TARGET_CREATED"), ("t.lnk", "C:\\y.exe", "LNK_MODIFIED")]


def test_detections(spark, tmp_path):
    lines = [
        json.dumps({"Timestamp": "2024-01-01 00:00:00", "EventID": 4624, "RuleTitle": "R", "Tags": ["a", "b"], "RecordID": 9, "Level": "high"}),
        "", "{broken", json.dumps({"Timestamp": "", "RuleTitle": "none"}), json.dumps({"Timestamp": "2024-01-01T00:00:01Z"}),
    ]
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = {r["provenance"]["source_row"]: r for r in P.detection_events(spark, str(path), "C").collect()}
    assert sorted(got) == [1, 5]
    assert got[1]["windows_event_id"] == "4624" and got[1]["attributes"]["record_id"] == "9"
    assert json.loads(got[1]["attributes"]["tags"]) == ["a", "b"]
    assert got[5]["description"] == "Hayabusa detection" and got[5]["attributes"]["tags"] is None
    _, rejects = P.read_detections(spark, str(path))
    assert [(r["source_row"], r["value"]) for r in rejects.collect()] == [(3, "{broken")]


def test_record_numbers_over_many_splits(spark, tmp_path):
    rows = [{"HiveType": "SYSTEM", "KeyPath": f"key{i:05}", "LastWriteTimestamp": "2024-01-01 00:00:00"} for i in range(3000)]
    path = write_csv(tmp_path / "recmd_big.csv", P.REQUIRED["recmd"], rows, bom=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        raw = P.read_csv(spark, path, "recmd", multiline=False)
        assert raw.select("source_row").rdd.getNumPartitions() >= 1
        got = {r["KeyPath"]: r["source_row"] for r in raw.select("KeyPath", "source_row").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"key{i:05}": i + 2 for i in range(3000)}


def test_listing_and_inventory(spark, tmp_path):
    listing = tmp_path / "listing.txt"
    listing.write_text("r/r 0-128-6: $MFT\nd/d 39-144-5:\tWindows\nr/r * 128-1: Windows/Prefetch/A.pf\n\nnoise\n")
    rows = {r["path"]: r for r in A.read_listing(spark, str(listing), "v").collect()}
    assert sorted(rows) == ["$MFT", "Windows", "Windows/Prefetch/A.pf"]
    assert rows["Windows/Prefetch/A.pf"]["deleted"] and rows["$MFT"]["metadata_address"] == "0-128-6"
    root = tmp_path / "case"
    for name in (
        "parsed/pecmd/pecmd_1.csv", "parsed/pecmd/pecmd_1_Timeline.csv", "parsed/recmd/recmd_20240101T000000Z_a.csv",
        "parsed/recmd/recmd_20240102T000000Z_b.csv", "parsed/recmd/recmd_20240102T000000Z_a.csv", "triage/prefetch/X.pf",
    ):
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    files = I.list_files(spark, str(root))
    latest = sorted((r["tool"], r["path"].rsplit("/", 1)[1]) for r in I.latest_inputs(files).collect())
    assert latest == [
        ("pecmd", "pecmd_1.csv"), ("recmd", "recmd_20240102T000000Z_a.csv"), ("recmd", "recmd_20240102T000000Z_b.csv"),
    ]
    states = {r["family"]: (r["state"], r["n"]) for r in I.capabilities(files).collect()}
    assert states["prefetch"] == ("AVAILABLE", 1) and states["mft"] == ("ABSENT", 0)
    tools = [r["tool"] for r in I.available_tools(files).orderBy("position").collect()]
    assert tools == ["pecmd", "recmd"]
    prints = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in I.fingerprints(spark, str(root / "triage/prefetch")).collect()}
    assert prints == {"X.pf": hashlib.sha256(b"x").hexdigest()}


def test_result_documents(spark, tmp_path):
    docs = {
        "index.json": {"finding_id": "i"}, "a.json": {"finding_id": "f1", "analysis": {"assessment": "X"}},
        "b.json": {"analysis": {"finding_id": "f2", "assessment": "Y"}}, "c.json": {"finding_id": "f1", "analysis": {"assessment": "Z"}},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    got = read_results(spark, str(tmp_path), "finding_id string, analysis struct<finding_id:string,assessment:string>")
    assert sorted((r["finding_id"], r["analysis"]["assessment"]) for r in got.collect()) == [("f1", "X"), ("f2", "Y")]


def test_adapters_share_one_schema(spark, tmp_path):
    path = write_csv(tmp_path / "lnk.csv", P.REQUIRED["lecmd"], [{"TargetCreated": "2024-01-01 00:00:00"}])
    events = P.shortcut_events(spark, path, "C")
    from tracewright.schema import EVENT_SCHEMA, conform

    assert events.columns == EVENT_SCHEMA.names
    with pytest.raises(ValueError, match="unknown normalized field"):
        conform(events.withColumn("surprise", F.lit(1)))
