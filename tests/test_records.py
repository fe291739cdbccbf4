"""Quoted records over many splits against Python's csv reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import parsers as P
from tracewright.sources.records import quoted_records, split_states


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def made(seed, rows, end):
    """Text of a CSV file and its rows, with fields over many lines, doubled quotes and empty lines between records."""
    rng = random.Random(seed)
    pieces = ["plain", "é", " pad ", "a,b", 'say "x"', "two\nlines", "\n", '"\n"', "x" * 900, "\n".join("deep" * 30 for _ in range(9)), ""]
    header = P.REQUIRED["recmd"]
    table = [[rng.choice(pieces) + str(i) for _ in header] for i in range(rows)]
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=end)
    writer.writerow(header)
    for row in table:
        writer.writerow(row)
        if rng.random() < 0.1:
            text.write(end)
    return header, table, text.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_over_splits(spark, tmp_path, small_splits, end):
    want, header = {}, None
    for seed in range(2):
        header, table, text = made(seed, 40, end)
        (tmp_path / f"f {seed}.csv").write_bytes(("﻿" * (seed == 1) + text).encode())
        want |= {(f"f {seed}.csv", i + 2): row for i, row in enumerate(table)}
    raw = P.read_csv(spark, str(tmp_path), "recmd")
    assert raw.rdd.getNumPartitions() > 20
    got = {(r["source_file"].rsplit("/", 1)[1], r["source_row"]): [r[c] for c in header] for r in raw.collect()}
    assert got == want


def test_same_rows_as_one_task(spark, tmp_path, small_splits):
    _, _, text = made(5, 60, "\n")
    (tmp_path / "a.csv").write_text(text, newline="")
    many = quoted_records(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    one = quoted_records(spark, str(tmp_path))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert one.rdd.getNumPartitions() == 1 and rows(one) == rows(many)


def test_open_field_empty_file_and_bytes_that_are_no_text(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n' + "x\n" * 3000)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "odd.csv").write_bytes(b'a\n"\xff\n\xfe"\n\n\nlast')
    got = {(r["file"].rsplit("/", 1)[1], r["number"]): r["value"] for r in quoted_records(spark, str(tmp_path)).collect()}
    assert got.pop(("open.csv", 2)).split("\n")[:3] == ['1,"never', "closed", "x"]
    assert got == {("open.csv", 1): "a,b", ("odd.csv", 1): "a", ("odd.csv", 2): '"�\n�"', ("odd.csv", 3): "last"}


def test_states_of_splits():
    row = lambda file, start, quotes, outside, inside: dict(file=file, start=start, quotes=quotes, outside=outside, inside=inside)
    plan, open_end = split_states([row("a", 10, 1, 7, 5), row("a", 0, 1, 3, 0), row("b", 0, 0, 2, 1), row("a", 20, 0, 4, 9)])
    assert plan == {("a", 0): (0, 1), ("a", 10): (1, 4), ("a", 20): (0, 9), ("b", 0): (0, 1)} and open_end
    assert split_states([row("b", 0, 0, 2, 1)])[1] is False


def test_header_names(spark, tmp_path):
    assert P.header_names('﻿a,"b ""c""",a') == ["a", 'b "c"', "a2"]
    (tmp_path / "none").mkdir()
    assert P.read_csv(spark, str(tmp_path / "none"), "recmd").filter(F.col("HivePath") == "").count() == 0
