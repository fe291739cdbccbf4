"""Plans on hand-written tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.plans import clusters as C
from tracewright.plans import correlate as K
from tracewright.plans import findings as P
from tracewright.plans import lookups as L
from tracewright.plans import progress as G
from tracewright.plans import quality as Q
from tracewright.plans import report as R
from tracewright.plans import retrieval as V
from tracewright.plans import routing as T
from tracewright.plans import synthesis as S
from tracewright.schema import conform

START = datetime(2024, 1, 1)


def make_events(spark, rows):
    """Events from dicts; ``at`` is seconds after START."""
    text = ["event_uid", "source_tool", "hostname", "username", "executable", "path", "target_path", "windows_event_id",
            "channel", "registry_value_data", "detection_rule", "severity", "description", "command_line", "timestamp_source", "artifact_type"]
    data = []
    for r in rows:
        at = START + timedelta(microseconds=round(r["at"] * 1e6)) if r.get("at") is not None else None
        data.append(tuple(r.get(c, "") for c in text) + (at, r.get("attrs", {}), ("p", "out", r.get("evidence", ""), r.get("row", 2))))
    schema = ", ".join(f"{c} string" for c in text) + (
        ", event_ts timestamp, attributes map<string,string>, provenance struct<parser:string,parser_output:string,source_evidence:string,source_row:bigint>"
    )
    df = spark.createDataFrame(data, schema)
    return conform(
        df.withColumn("case_id", F.lit("C")).withColumn("timestamp", F.coalesce(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")))
    )


def edge(uid_a, uid_b, confidence, relation="SHARED_PATH_NEAR_TIME", tools=("pecmd", "mftecmd")):
    return (f"{uid_a}-{uid_b}-{confidence}", uid_a, uid_b, *tools, relation, confidence, {"paths": ["p"]})


EDGE_SCHEMA = (
    "edge_uid string, event_uid_a string, event_uid_b string, source_tool_a string, source_tool_b string, "
    "relationship_type string, confidence string, shared_keys map<string,array<string>>"
)


def test_detection_edges(spark):
    log = {"source_tool": "evtxecmd", "windows_event_id": "7", "channel": "Sec", "hostname": "H", "evidence": "C:\\l\\Sec.evtx"}
    hit = {"source_tool": "hayabusa", "windows_event_id": " 7 ", "channel": "sec ", "hostname": "h", "attrs": {"record_id": "5", "evtx_file": "x/SEC.EVTX"}}
    events = make_events(spark, [
        {**hit, "event_uid": "a", "at": 10},
        {**log, "event_uid": "same", "at": 10, "attrs": {"event_record_id": "5"}},
        {**log, "event_uid": "edge", "at": 12, "attrs": {"record_number": "5"}, "hostname": "", "channel": "", "evidence": "other"},
        {**log, "event_uid": "late", "at": 12.000001, "attrs": {"record_number": "5"}},
        {**log, "event_uid": "norecord", "at": 10, "attrs": {}},
        {**log, "event_uid": "otherid", "at": 10, "windows_event_id": "8", "attrs": {"record_number": "5"}},
    ])
    got = {(r["event_uid_a"], r["event_uid_b"]): r for r in K.edges_from_matches(K.detection_matches(events), "r").collect()}
    assert set(got) == {("a", "same"), ("a", "edge")}
    assert got[("a", "same")]["score"] == 1.0 and got[("a", "same")]["confidence"] == "VERY_HIGH"
    assert got[("a", "edge")]["score"] == 0.75 and got[("a", "edge")]["time_delta_seconds"] == 2.0
    assert got[("a", "same")]["shared_keys"]["evtx_file"] == ["sec.evtx"]


def test_shared_key_scores_and_fanout(spark):
    rows = [{"event_uid": "anchor", "source_tool": "pecmd", "at": 100, "executable": "X.EXE", "hostname": "h", "username": "u"}]
    rows += [
        {"event_uid": f"m{i:02}", "source_tool": "mftecmd", "at": 100 + i * 0.05, "path": "C:\\Windows\\Prefetch\\X.EXE-0000000A.pf"} for i in range(12)
    ]
    rows += [
        {"event_uid": "same", "source_tool": "pecmd", "at": 100, "executable": "x.exe"},
        {"event_uid": "host", "source_tool": "lecmd", "at": 101, "target_path": "D:/x.exe", "hostname": "H", "username": "U"},
        {"event_uid": "out", "source_tool": "mftecmd", "at": 101.000001, "path": "c:\\x.exe"},
    ]
    events = make_events(spark, rows)
    anchors = K.uncrowded_anchors(events)
    matches = K.shared_key_matches(anchors, events)
    mine = {r["c_uid"]: r for r in matches.filter("a_uid = 'anchor'").collect()}
    assert len(mine) == 10 and "same" not in mine and "out" not in mine
    # host and user raise the far match above the near ones; ties go by distance, then uid
    assert round(mine["host"]["raw_score"], 4) == 0.82
    assert sorted(mine) == ["host"] + [f"m{i:02}" for i in range(9)]
    assert mine["m02"]["raw_score"] == 0.78 and mine["m03"]["raw_score"] == 0.72


def test_shared_path_scores(spark):
    events = make_events(spark, [
        {"event_uid": "a", "source_tool": "lecmd", "at": 10, "path": "C:/T/f.txt", "hostname": "h"},
        {"event_uid": "b", "source_tool": "mftecmd", "at": 10.1, "path": '"c:\\t\\\\F.TXT"', "hostname": "H"},
        {"event_uid": "c", "source_tool": "mftecmd", "at": 10.100001, "path": "c:\\t\\f.txt"},
        {"event_uid": "d", "source_tool": "mftecmd", "at": 10, "path": "$MFT"},
    ])
    matches = K.shared_key_matches(K.uncrowded_anchors(events), events).filter(F.col("relationship_type") == K.PATH)
    assert {r["c_uid"]: round(r["raw_score"], 4) for r in matches.collect()} == {"b": 0.95, "c": 0.85}


def test_pairs_with_several_keys(spark):
    anchor = {"event_uid": "a", "source_tool": "lecmd", "at": 10, "path": "C:/T/one.exe", "target_path": "C:/T/two.exe"}
    both = [{"event_uid": f"b{i:02}", "source_tool": "mftecmd", "at": 10 + i * 0.01, "path": "c:\\t\\two.exe", "target_path": "c:\\t\\one.exe"} for i in range(12)]
    other = {"event_uid": "n", "source_tool": "mftecmd", "at": 10, "path": "D:/x/one.exe"}
    matches = K.shared_key_matches(K.uncrowded_anchors(make_events(spark, [anchor, *both, other])), make_events(spark, [anchor, *both, other]))
    rows = matches.filter("a_uid = 'a'").collect()
    paths = {r["c_uid"]: r["shared_keys"] for r in rows if r["relationship_type"] == K.PATH}
    names = {r["c_uid"]: r["shared_keys"] for r in rows if r["relationship_type"] == K.EXECUTABLE}
    assert len(rows) == len(paths) + len(names)  # a pair with two keys is one row of each kind
    assert set(paths) == {r["event_uid"] for r in both}
    assert all([k[-7:] for k in shared["paths"]] == ["one.exe", "two.exe"] for shared in paths.values())
    assert sorted(names) == [f"b{i:02}" for i in range(9)] + ["n"]  # ten pairs, however many keys each has
    assert names["n"] == {"executables": ["one.exe"]} and names["b00"] == {"executables": ["one.exe", "two.exe"]}
    none = K.shared_key_matches(K.uncrowded_anchors(make_events(spark, [anchor, *both])), make_events(spark, [anchor, *both]), fanout=0)
    assert {r["relationship_type"] for r in none.collect()} == {K.PATH}


def test_key_join_moves_rows_of_fixed_size(spark):
    events = make_events(spark, [{"event_uid": "a", "source_tool": "lecmd", "at": 10, "path": "C:/T/one.exe"}])
    matches = K.shared_key_matches(K.uncrowded_anchors(events), events)
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("hash" in line for line in joins) and not any("keys" in line for line in joins)
    assert "array_intersect" not in plan


def test_keep_first_edge_and_crowd(spark):
    events = make_events(spark, [
        {"event_uid": "early", "source_tool": "recmd", "at": 1, "path": "c:\\p\\q", "registry_value_data": "run C:\\k\\tool.exe"},
        {"event_uid": "later", "source_tool": "lecmd", "at": 1.5, "path": "c:\\p\\q", "executable": "tool.exe"},
    ])
    edges = K.correlate(events, "r").collect()
    assert sorted((e["relationship_type"], e["event_uid_a"], e["event_uid_b"]) for e in edges) == [
        ("SHARED_EXECUTABLE_NEAR_TIME", "early", "later"), ("SHARED_PATH_NEAR_TIME", "early", "later"),
    ]
    assert K.correlate(events, "r", crowd_limit=0).count() == 0


def test_weak_attachment(spark):
    edges = spark.createDataFrame([
        edge("a", "b", "HIGH"), edge("c", "d", "VERY_HIGH"), edge("a", "b", "MEDIUM"), edge("b", "c", "MEDIUM"),
        edge("b", "x", "MEDIUM"), edge("x", "d", "MEDIUM"), edge("y", "z", "MEDIUM"), edge("a", "x", "MEDIUM"),
    ], EDGE_SCHEMA)
    events = make_events(spark, [{"event_uid": u, "source_tool": "pecmd" if u in "ac" else "mftecmd", "at": ord(u)} for u in "abcdxyz"])
    weak = C.attach_weak_edges(edges, C.core_labels(edges))
    assert {r["edge_uid"]: r["placement"] for r in weak.collect()} == {
        "a-b-MEDIUM": "SAME_CORE", "b-c-MEDIUM": "CROSS_CORE", "b-x-MEDIUM": "ATTACHED", "x-d-MEDIUM": "ATTACHED",
        "y-z-MEDIUM": "UNCLUSTERED", "a-x-MEDIUM": "ATTACHED",
    }
    clusters, members, cluster_edges = C.build_clusters(events, edges, "r")
    got = {r["start_ts"]: r for r in clusters.collect()}
    by_core = sorted((r["event_count"], r["edge_count"], r["independent_family_count"], r["cluster_confidence"]) for r in got.values())
    assert by_core == [(3, 2, 2, "HIGH"), (3, 4, 2, "HIGH")]
    assert members.filter("event_uid = 'x'").count() == 2
    assert {r["membership_role"] for r in members.filter("event_uid = 'x'").collect()} == {"MEDIUM_ATTACHMENT"}
    again, _, _ = C.build_clusters(events.repartition(3), edges.repartition(5), "r")
    assert {r["cluster_id"] for r in again.collect()} == {r["cluster_id"] for r in clusters.collect()}


def test_candidates_and_suppression(spark):
    edges = spark.createDataFrame([
        edge("a", "b", "HIGH"), edge("a", "b", "MEDIUM"), edge("c", "d", "MEDIUM"),
        edge("e", "f", "MEDIUM", tools=("evtxecmd", "hayabusa")), edge("g", "h", "MEDIUM", relation="HAYABUSA_EVTX_MATCH"),
    ], EDGE_SCHEMA)
    tools = {"a": "pecmd", "b": "mftecmd", "c": "pecmd", "d": "mftecmd", "e": "evtxecmd", "f": "hayabusa", "g": "pecmd", "h": "mftecmd"}
    events = make_events(spark, [{"event_uid": u, "source_tool": t, "at": 1, "path": f"C:\\{u}"} for u, t in tools.items()])
    clusters, cluster_events, _ = C.build_clusters(events, edges, "r")
    candidates, candidate_events, candidate_edges, keys = C.build_candidates(events, edges, "r")
    assert candidates.count() == 2 and candidate_edges.count() == 2
    covered = P.covered_candidates(candidate_events, clusters, cluster_events)
    assert covered.join(candidate_events, "candidate_id").select("event_uid").distinct().count() == 2
    found, evidence, values = P.build_findings(events, clusters, cluster_events, candidates, candidate_events, keys, "f")
    kinds = {r["finding_type"]: r for r in found.collect()}
    assert set(kinds) == {"CROSS_ARTIFACT_ACTIVITY_LEAD", "CORE_CROSS_ARTIFACT_LEAD"}
    lead = kinds["CROSS_ARTIFACT_ACTIVITY_LEAD"]
    roles = {r["event_uid"]: r["evidence_role"] for r in evidence.filter(F.col("finding_id") == lead["finding_id"]).collect()}
    assert roles == {"c": "EXECUTION_EVIDENCE", "d": "FILESYSTEM_EVIDENCE"}
    paths = {r["value"] for r in values.filter((F.col("finding_id") == lead["finding_id"]) & (F.col("kind") == "PATH")).collect()}
    assert paths == {"p", "C:\\c", "C:\\d"}


def test_core_lead_title_and_services(spark):
    edges = spark.createDataFrame([edge("a", "b", "HIGH")], EDGE_SCHEMA)
    events = make_events(spark, [
        {"event_uid": "a", "source_tool": "evtxecmd", "at": 1, "attrs": {"svc": " MySvc ", "payload": '{"x":["ServiceName","#text":"Svc2"]}', "p2": "'Svc': 'three'"}},
        {"event_uid": "b", "source_tool": "mftecmd", "at": 1, "path": "C:\\Windows\\Prefetch\\ZED.EXE-0A1B2C3D.pf"},
    ])
    clusters, cluster_events, _ = C.build_clusters(events, edges, "r")
    found, _, values = P.core_leads(events, clusters, cluster_events, "f")
    assert [r["title"] for r in found.collect()] == ["Cross-artifact forensic lead: zed.exe"]
    assert {r["value"] for r in values.filter("kind = 'SERVICE'").collect()} == {"MySvc", "Svc2", "three"}


def test_detection_leads_threshold(spark):
    edges = spark.createDataFrame([edge("a", "b", "HIGH"), edge("c", "d", "HIGH")], EDGE_SCHEMA)
    events = make_events(spark, [
        {"event_uid": "a", "source_tool": "hayabusa", "at": 1, "severity": "med", "detection_rule": "R2"},
        {"event_uid": "b", "source_tool": "hayabusa", "at": 1, "severity": "CRIT", "description": "R1"},
        {"event_uid": "c", "source_tool": "hayabusa", "at": 1, "severity": "low", "detection_rule": "R"},
        {"event_uid": "d", "source_tool": "evtxecmd", "at": 1},
    ])
    clusters, cluster_events, _ = C.build_clusters(events, edges, "r")
    found, evidence, _ = P.detection_leads(events, clusters, cluster_events, "f")
    assert [(r["severity"], r["title"], r["evidence_count"]) for r in found.collect()] == [("CRITICAL", "Detection lead: R1 (+1 related)", 2)]
    assert evidence.count() == 2


def test_history_and_standalone_fallback(spark):
    lnk = {"source_tool": "lecmd", "timestamp_source": "LNK.TargetCreated"}
    rows = [
        {**lnk, "event_uid": "s1", "at": 5, "target_path": "C:/Users/b/Downloads/run.PS1"},
        {**lnk, "event_uid": "s2", "at": 3, "target_path": "c:\\users\\b\\downloads\\RUN.ps1"},
        {**lnk, "event_uid": "s3", "at": 3, "target_path": "C:\\Program Files\\x.exe"},
        {**lnk, "event_uid": "s4", "at": 3, "target_path": "C:\\Users\\b\\Desktop\\z.zip"},
        {**lnk, "event_uid": "s5", "at": 3, "target_path": "C:\\Users\\b\\Desktop\\y.zip", "timestamp_source": "LNK.SourceCreated"},
    ]
    empty_edges = spark.createDataFrame([], EDGE_SCHEMA)

    def run(extra):
        events = make_events(spark, rows + extra)
        clusters, cluster_events, _ = C.build_clusters(events, empty_edges, "r")
        candidates, candidate_events, _, keys = C.build_candidates(events, empty_edges, "r")
        return P.build_findings(events, clusters, cluster_events, candidates, candidate_events, keys, "f")

    found, evidence, _ = run([])
    got = sorted((r["confidence"], r["title"], r["evidence_count"]) for r in found.collect())
    assert got == [("LOW", "Standalone LNK package artifact lead: C:\\Users\\b\\Desktop\\z.zip", 1), ("MEDIUM", "Standalone LNK execution artifact lead: run.PS1", 2)]
    assert evidence.count() == 3
    found, evidence, _ = run([{"event_uid": "h", "source_tool": "powershell_history", "command_line": "Add-MpPreference -ExclusionPath C:\\"}])
    assert [(r["finding_type"], r["title"]) for r in found.collect()] == [("POWERSHELL_HISTORY_LEAD", "PowerShell history lead: Defender exclusion change")]


@pytest.mark.parametrize(
    "severity,families,size,route,score",
    [
        ("CRITICAL", 1, 1, "DEEP_8B", 120), ("HIGH", 2, 10, "DEEP_8B", 120), ("MEDIUM", 1, 9, "FAST_4B", 50), ("UNASSESSED", 2, 9, "FAST_4B", 45),
        ("UNASSESSED", 1, 10, "STORE_ONLY", 25), ("LOW", 1, 1, "STORE_ONLY", 10), ("", 1, 1, "STORE_ONLY", 0), ("INFO", 2, 1, "FAST_4B", 25),
    ],
)
def test_routing(spark, severity, families, size, route, score):
    df = spark.createDataFrame([(severity, families, size)], "severity string, independent_family_count long, evidence_count long")
    row = df.select(*[c.alias(n) for n, c in T.route_columns().items()]).first()
    assert (row["planned_route"], row["routing_score"]) == (route, score)
    assert row["reasons"]


def test_routes_replace_their_run(spark, tmp_path):
    schema = "run_id string, finding_id string"
    path = str(tmp_path / "routes")
    T.write_routes(spark.createDataFrame([("r1", "a"), ("r2", "b")], schema), path)
    T.write_routes(spark.createDataFrame([("r1", "c")], schema), path)
    assert sorted((r["run_id"], r["finding_id"]) for r in spark.read.parquet(path).collect()) == [("r1", "c"), ("r2", "b")]


def test_deep_inputs(spark):
    routes = spark.createDataFrame([("a", "DEEP_8B", "PENDING"), ("b", "FAST_4B", "ESCALATE_8B"), ("c", "FAST_4B", "PENDING"), ("d", "DEEP_8B", "PENDING")], "finding_id string, planned_route string, status string")
    done = spark.createDataFrame([("d",)], "finding_id string")
    packages = spark.createDataFrame([("a", "pkg")], "finding_id string, package string")
    refs = spark.createDataFrame([("a", "2", "late"), ("a", "1", "first")], "finding_id string, source_path string, references string")
    ready, missing = T.deep_inputs(routes, done, packages, refs)
    assert [(r["finding_id"], r["references"]) for r in ready.collect()] == [("a", "first")]
    assert [r["finding_id"] for r in missing.collect()] == ["b"]


def test_diversified_order_of_steps(spark):
    rows = [
        {"event_uid": f"p{i}", "source_tool": "pecmd", "artifact_type": "prefetch", "at": i // 2 * 0.1, "executable": "A.EXE"} for i in range(5)
    ]
    rows += [
        {"event_uid": "h", "source_tool": "hayabusa", "artifact_type": "hayabusa_detection", "at": 50, "description": "d"},
        {"event_uid": "e", "source_tool": "evtxecmd", "artifact_type": "evtx", "at": 50, "attrs": {"map_description": "logon"}},
        {"event_uid": "r", "source_tool": "recmd", "artifact_type": "registry", "at": 60, "description": "Registry key LastWrite observation"},
    ]
    events = make_events(spark, rows)
    supports = spark.createDataFrame(
        [(f"p{i}", 1, "T") for i in range(5)] + [("h", 2, "U"), ("e", 2, "U"), ("e", 2, "U"), ("e", 3, "V")], "event_uid string, seq long, title string"
    )
    got = [(r["event_uid"], r["selection_reason"]) for r in R.diversified_evidence(events, supports).collect()]
    # three rows of T are counted first, then rows equal to the second collapse to one
    assert got == [("p0", "Supports finding: T"), ("e", "Supports finding: U; V"), ("h", "Supports finding: U")]


def test_trusted_time(spark):
    rows = [("lecmd", "LNK.SourceCreated", "2024"), ("lecmd", "LNK.TargetCreated", "2000-01-01 00:00:00"), ("mftecmd", "LNK.SourceCreated", "2024"), ("lecmd", None, "2024")]
    df = spark.createDataFrame(rows, "source_tool string, timestamp_source string, timestamp string")
    flags = lambda p: [r[0] for r in df.select(L.trusted_time(p)).collect()]
    assert flags(None) == [True, False, True, True] and flags(False) == [False, False, True, True]


def test_lookups_reject_bad_arguments(spark):
    events = make_events(spark, [{"event_uid": "a", "at": 0}])
    with pytest.raises(ValueError):
        L.events_by_time(events, "2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        L.events_by_artifact(events, "mft", limit=10001)
    assert L.events_by_time(events, "2024-01-01", "2024-01-01").count() == 1
    runs = spark.createDataFrame([("r1", "COMPLETED", "1", "2024"), ("r2", "COMPLETED", "1", "2025"), ("r3", "FAILED", "1", "2026")], "run_id string, status string, engine string, completed_utc string")
    assert [r[0] for r in L.latest_run(runs, "engine", "1").collect()] == ["r2"]
    assert L.latest_run(runs, "engine", "9").count() == 0


def test_result_grounding(spark):
    results = spark.createDataFrame(
        [("ok", "NEEDS_REVIEW", "LOW", "LOW", False, ["u1"]), ("bad", "SUSPICIOUS", "LOW", "LOW", False, ["u1", "zz"]), ("enum", "MAYBE", "LOW", None, True, [])],
        "finding_id string, assessment string, priority string, confidence string, escalate boolean, supporting_event_uids array<string>",
    )
    evidence = spark.createDataFrame([("ok", "u1", 0), ("bad", "u1", 0), ("bad", "u2", 1)], "finding_id string, event_uid string, position int")
    got = {r["finding_id"]: r["problems"] for r in Q.result_problems(results, evidence).collect()}
    assert got == {"bad": ["escalation", "unknown_uid"], "enum": ["assessment", "confidence"]}
    facts = spark.createDataFrame([("ok", 1, ["u1"]), ("ok", 2, []), ("bad", 1, ["q"])], "finding_id string, fact_no int, event_uids array<string>")
    assert sorted((r["finding_id"], r["problem"]) for r in Q.fact_problems(facts, evidence).collect()) == [("bad", "unknown_uid"), ("ok", "no_uid")]
    indexes = spark.createDataFrame([("bad", [1, 1, 7])], "finding_id string, evidence_indexes array<int>")
    assert sorted((r["position"], r["event_uid"]) for r in Q.uids_of_indexes(indexes, evidence).collect()) == [(1, "u2"), (7, None)]


def test_related_activity(spark):
    base = [("f1", "A", 0), ("f2", "B", 900), ("f3", "A", 1801), ("f4", "A", 2000), ("f5", "Z", 9000)]
    rows = [(f, t, "th", "h", f"u{f}", START + timedelta(seconds=s)) for f, t, s in base]
    df = spark.createDataFrame(rows, "finding_id string, title string, theme string, hostname string, event_uid string, event_ts timestamp")
    got = [(r["finding_count"], r["titles"]) for r in S.related_activity(df).collect()]
    assert got == [(2, ["A", "B"])]


def test_candidate_findings_signature(spark):
    rows = [
        ("a", "HIGH", "X", "t1", 1), ("b", "MEDIUM", "REVIEW_REQUIRED", "t1", 1), ("c", "MEDIUM", "REVIEW_REQUIRED", "t1", 5),
        ("d", "MEDIUM", "REVIEW_REQUIRED", "t2", 1), ("e", "LOW", "AMBIGUOUS", "t", 1), ("f", "LOW", "REVIEW_REQUIRED", "t", 1), ("g", "UNASSESSED", "", "t", 1),
    ]
    df = spark.createDataFrame(rows, "finding_id string, severity string, state string, title string, evidence_count long")
    assert sorted(r[0] for r in V.candidate_findings(df, ["title"]).collect()) == ["a", "c", "d", "e", "g"]


def test_progress_never_goes_back(spark):
    df = spark.createDataFrame([("c", "CORRELATION"), ("c", "parsing"), ("d", "x")], "case_id string, line string")
    assert [(r["phase"], r["percent"]) for r in G.case_progress(df).collect()] == [("Correlation", 41.2)]
