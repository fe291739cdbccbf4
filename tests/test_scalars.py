"""Column functions on hand-written rows."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.functions import labels as B
from tracewright.functions import payload as P
from tracewright.functions import text as X
from tracewright.functions import times as M
from tracewright.plans import acquisition as A
from tracewright.plans import findings as FD
from tracewright.plans import retrieval as V
from tracewright.plans import telemetry as T
from tracewright.sources.parsers import mft_path


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_canonical_timestamp(spark):
    rows = [
        ("2024-01-02T03:04:05.1234567",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",),
        (" 2024-01-02 03:04:05 ",), ("yesterday",), ("2024",), ("",), (None,),
    ]
    assert values(spark, rows, "t string", M.canonical_timestamp_sort(F.col("t"))) == [
        "2024-01-02 03:04:05.123456", "2024-01-02 03:04:05.000000", "2024-01-02 01:04:05.000000",
        "2024-01-02 03:04:05.000000", None, None, None, None,
    ]


def test_filetime(spark):
    normal = 133485408000000000
    rows = [(0,), (9223372036854775807,), (normal,), (normal + 9,), (-1,)]
    got = values(spark, rows, "t long", M.format_ts(M.filetime_to_ts(F.col("t"))))
    assert got == [None, None, "2024-01-01 00:00:00.000000", "2024-01-01 00:00:00.000000", None]


def test_paths(spark):
    rows = [('"C:/A//B\\c.EXE"',), ("'x'",), (" $MFT ",), ("\\",), ("ab",), (None,), ("c:foo.exe",), ("C:\\",)]
    assert values(spark, rows, "p string", X.norm_path("p")) == [
        "c:\\a\\b\\c.exe", "x", "$mft", "\\", "ab", "", "c:foo.exe", "c:\\",
    ]
    assert values(spark, rows, "p string", X.norm_executable("p")) == [
        "c.exe", "x", "$mft", "", "ab", "", "foo.exe", "",
    ]
    assert values(spark, rows, "p string", X.path_keys("p")) == [
        ["c:\\a\\b\\c.exe"], [], [], [], [], [], ["c:foo.exe"], ["c:\\"],
    ]


def test_executable_keys(spark):
    rows = [("", "C:\\Windows\\Prefetch\\VMTOOL.EXE-B05FE979.pf", "", "Absolute path: C:\\Ev\\a.exe; \\Device\\X\\b.EXE end")]
    got = values(
        spark, rows, "e string, p string, t string, d string",
        F.array_sort(X.executable_keys("e", "p", "t", text=F.col("d"))),
    )
    assert got == [["a.exe", "b.exe", "vmtool.exe", "vmtool.exe-b05fe979.pf"]]
    without = values(spark, rows, "e string, p string, t string, d string", F.array_sort(X.executable_keys("e", "p", "t")))
    assert without == [["vmtool.exe", "vmtool.exe-b05fe979.pf"]]


def test_attributes(spark):
    rows = [({"Record ID": " 7 ", "x": "1"},), ({"recordid": "", "EventRecordId": "9"},), ({},), (None,)]
    got = values(spark, rows, "m map<string,string>", X.attribute("m", "record_id", "recordid", "event_record_id"))
    assert got == ["7", "9", "", ""]
    pairs = F.create_map(F.lit("A b"), F.col("v"), F.lit("ab"), F.lit(" 2 "))
    canonical = values(spark, [("1",)], "v string", X.canonical_attributes(pairs))
    assert canonical == [{"ab": "2"}]


@pytest.mark.parametrize(
    "score,band", [(0.9, "VERY_HIGH"), (0.8999, "HIGH"), (0.8, "HIGH"), (0.7, "MEDIUM"), (0.6999, "LOW")]
)
def test_score_bands(spark, score, band):
    assert values(spark, [(score,)], "s double", B.confidence_from_score(F.col("s"))) == [band]


def test_severity_and_short(spark):
    rows = [("Informational",), ("CRIT ",), ("med",), ("weird",), (None,)]
    assert values(spark, rows, "s string", B.normalize_severity("s")) == ["INFO", "CRITICAL", "MEDIUM", "UNKNOWN", "UNKNOWN"]
    assert values(spark, [("abcdef",), (" abc ",)], "s string", X.short("s", 3)) == ["abc...[truncated]", "abc"]
    assert values(spark, [(["A", "a ", "", "b", "B"],)], "s array<string>", X.dedupe_ci(F.col("s"))) == [["A", "b"]]
    assert values(spark, [('["a","b"]',), ("no",)], "s string", X.json_list("s")) == [["a", "b"], []]


def test_payload(spark):
    rows = [
        ('{"EventData":{"Data":[{"@Name":"A","#text":"1"},{"@Name":"A","#text":"2"},{"@Name":""}]}}',),
        ('{"EventData":{"Data":{"@Name":"B","#text":" x "}}}',), ("broken",), (None,),
    ]
    assert values(spark, rows, "p string", P.parse_event_payload(F.col("p"))) == [{"A": "2"}, {"B": "x"}, {}, {}]


def test_persistence_observation(spark):
    rows = [
        ("7045", {"ServiceName": "S", "StartType": "auto"}, {"executable_info": "C:\\s.exe"}),
        ("4720", {"TargetUserName": "u", "TargetDomainName": "D", "TargetSid": "S-1"}, {}),
        ("4732", {"TargetUserName": "G", "MemberName": "-", "MemberSid": "S-2"}, {}),
        ("4698", {}, {}), ("4740", {"TargetUserName": "u"}, {}), ("4697", {}, {"map_description": "m"}), ("7045", {}, {}),
    ]
    got = values(
        spark, rows, "e string, p map<string,string>, a map<string,string>",
        P.persistence_observation(F.col("e"), F.col("p"), F.col("a")),
    )
    assert got == [
        "Service: S | Image: C:\\s.exe | Start: auto", "Account created: D\\u | SID: S-1", "Group: G | Member: S-2",
        "Scheduled task created", "Account locked: u", "m", "Service installation event",
    ]


def test_identity_and_theme(spark):
    rows = [("",), ("-\\-",), ("HOST$",), ("NT AUTHORITY\\SYSTEM",), ("bob",)]
    assert values(spark, rows, "u string", P.classify_auth_identity(F.col("u"))) == [
        "UNKNOWN", "UNKNOWN", "SYSTEM / SERVICE", "SYSTEM / SERVICE", "USER / OTHER",
    ]
    titles = [("New Service account",), ("RDP session",), ("Password",), ("WMI",), ("x",)]
    assert values(spark, titles, "t string", P.finding_theme(F.col("t"))) == [
        "Service / Execution Activity", "Remote Access Activity", "Identity / Privilege Activity",
        "System / Configuration Activity", "Other Investigation Activity",
    ]


def test_recommendations(spark):
    rows = [
        ('{"action":"Do it","reason":"why"}',), ('{"action":"Only"}',), ("{broken",),
        ('Check, "target_evidence": "x" evidence_indexes: [1, 2],',), (None,),
    ]
    assert values(spark, rows, "r string", P.clean_recommendation(F.col("r"))) == [
        "Do it Reason: why", "Only", "broken", "Check", "",
    ]
    assert values(spark, [("Do  IT! now Reason: b",)], "r string", P.recommendation_key(F.col("r"))) == ["do it now"]


def test_account_record(spark):
    normal = 133485408000000000
    raw = bytearray(0x44)
    struct.pack_into("<Q", raw, 0x08, normal)
    struct.pack_into("<Q", raw, 0x20, 0x7FFFFFFFFFFFFFFF)
    struct.pack_into("<Q", raw, 0x28, 2**64 - 1)
    struct.pack_into("<I", raw, 0x30, 1001)
    struct.pack_into("<I", raw, 0x38, 0xFFFFFFFF)
    struct.pack_into("<H", raw, 0x40, 65535)
    struct.pack_into("<H", raw, 0x42, 12)
    got = values(spark, [(bytearray(raw),), (bytearray(b"\x00" * 10),), (None,)], "b binary", T.decode_account_record(F.col("b")))
    first = got[0].asDict()
    assert first["last_logon"] == datetime(2024, 1, 1)
    assert first["password_last_set"] is None and first["account_expires"] is None and first["last_failed_logon"] is None
    assert (first["rid_from_f"], first["account_control_raw"], first["failed_logon_count"], first["logon_count"]) == (
        1001, 4294967295, 65535, 12,
    )
    assert got[1] is None and got[2] is None


def test_logical_path(spark):
    rows = [
        ("Img(x)/vol/[ROOT]/Windows/A",), ("\\Windows\\System32\\",), ("part1/Users//bob/f",), ("misc/file",), ("x/[root]",), ("",),
    ]
    assert values(spark, rows, "p string", A.logical_path(F.col("p"))) == [
        "Windows/A", "Windows/System32", "Users/bob/f", "misc/file", "", "",
    ]


def test_classifier_exclusions(spark):
    rows = [
        ("Users/a:b/AppData/Roaming/Microsoft/Windows/Recent/x.lnk",),
        ("Users/bob/AppData/Roaming/Microsoft/Windows/Recent/CustomDestinations/y.lnk",),
        ("Users/bob/Downloads/a.zip",), ("Windows/System32/config/SAM.LOG",), ("Windows/System32/config/other",),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, p string")
    got = [tuple(r) for r in A.classify_paths(df, "p").orderBy("i").select("rule_id", "output_name").collect()]
    assert got == [
        ("windows_recent_lnk", "a_b/x.lnk"),
        ("windows_user_lnk", "bob/AppData/Roaming/Microsoft/Windows/Recent/CustomDestinations/y.lnk"),
        (None, None), ("registry_machine_transaction_log", "SAM.LOG"), (None, None),
    ]


def test_lead_targets(spark):
    rows = [
        ("c:\\users\\b\\downloads\\a.exe",), ("c:\\program files\\a.exe",), ("c:\\users\\b\\appdata\\a.exe",),
        ("c:\\users\\b\\appdata\\a.ps1",), ("c:\\users\\b\\desktop\\a.zip",), ("c:\\users\\b\\desktop\\a.txt",),
        ("c:\\users\\b\\desktop\\.exe",),
    ]
    assert values(spark, rows, "p string", FD.is_lead_target(F.col("p"))) == [True, False, False, True, True, False, False]


def test_mft_path(spark):
    rows = [(".", "a"), ("", "a"), (".\\x", "a"), ("x\\", "a")]
    assert values(spark, rows, "p string, n string", mft_path(F.col("p"), F.col("n"))) == ["a", "a", ".\\x\\a", "x\\a"]


def test_rerank_and_grounding(spark):
    rows = [("what router?", 0.5, "SSH router switch " * 3, "x"), ("before impact", 0.5, "", "Impact"), ("else", 0.5, "router", "impact")]
    got = values(spark, rows, "q string, s double, t string, p string", F.round(V.rerank_score(F.col("q"), F.col("s"), F.col("t"), F.col("p")), 4))
    assert got == [0.575, 0.42, 0.5]
    answers = [("used nmap 5. Historical Examples psexec", ""), ("nmap", ""), ("nmap 5. historical examples", "NMAP?")]
    assert values(spark, answers, "a string, q string", V.grounding_violations(F.col("a"), F.col("q"))) == [
        ["nmap"], ["Historical Examples section not found"], [],
    ]
