"""Logs that cases share: as many files as writers, however many cases; the order of a case goes on from file to file."""

from pathlib import Path

from pyspark.sql import functions as F
from test_running import LINES, plain

from tracewright.registry import catalog
from tracewright.streaming.progress import read_progress, start_line_progress, stream_shared_lines, write_shared_lines

TEXTS = sorted([*LINES, "a\rb", 'c\t"d"'])


def test_progress_of_shared_logs(spark, tmp_path):
    cases = spark.range(300).select(F.col("id").cast("string").alias("case_id")).unionByName(spark.createDataFrame([(None,)], "case_id string"))
    lines = cases.crossJoin(spark.createDataFrame([(t,) for t in TEXTS], "line string")).unionByName(
        spark.range(2000).select(F.lit("hub").alias("case_id"), F.format_string("%05d note", "id").alias("line"))
    )
    logs, table, state = str(tmp_path / "logs"), str(tmp_path / "table"), str(tmp_path / "state")
    write_shared_lines(lines, f"{logs}/1", ["case_id", "line"])
    assert len(list(Path(logs).rglob("*.txt"))) <= 8
    run = lambda: start_line_progress(stream_shared_lines(spark, logs), table, state, once=True).awaitTermination()
    run()
    got = {}
    for r in read_progress(spark, table).orderBy("file", "position").collect():
        got.setdefault(r.case_id, []).append((r.line, r.detected, r.phase_index, r.started))
    assert got.pop("hub") == plain([f"{i:05} note" for i in range(2000)])
    assert len(got) == 301 and all(rows == plain(TEXTS) for rows in got.values())
    (Path(logs) / "2.txt").write_text('{"line":"boot"}\nno JSON: PARSING\n')
    run()
    late = {r.line: (r.case_id, r.phase_index) for r in read_progress(spark, table).filter("batch = 1").collect()}
    assert late == {"boot": (None, 17), "no JSON: PARSING": (None, 17)}


def test_query_writes_no_file_per_conversation(spark):
    base = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) / "streams"
    before = set(base.glob("*"))
    rows = catalog.queries()["stream_line_progress"](spark, "/root/testdata/sf0.01")
    assert rows.select("case_id").distinct().count() > 50
    (mine,) = set(base.glob("*")) - before
    assert len(list(mine.glob("logs/**/part-*"))) <= 8
