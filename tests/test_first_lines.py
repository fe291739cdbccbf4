"""Header lines of many files."""

from tracewright.sources import parsers as P


def test_first_lines_without_a_sort_of_all_lines(spark, tmp_path):
    sizes = {"a.csv": 4000, "b.csv": 1, "c d.csv": 50}
    for name, rows in sizes.items():
        (tmp_path / name).write_text(f"head,{name}\n" + "".join(f"{i},x\n" for i in range(rows)))
    (tmp_path / "blank.csv").write_text("\nhead\n")
    (tmp_path / "none.csv").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for split in ("700", before["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = P.first_lines(spark, str(tmp_path))
            got = {r.file.rsplit("/", 1)[1]: r.header for r in found.collect()}
            assert got == {name: f"head,{name}" for name in sizes} | {"blank.csv": ""}
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and "Sort [" not in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
