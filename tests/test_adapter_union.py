"""Counting the events of four tools moves no payloads."""

from tracewright.registry import catalog


def test_only_counted_columns_are_moved(spark):
    counts = catalog.queries()["adapter_union"](spark, "/root/testdata/sf0.001")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    chosen = [line for line in plan.splitlines() if "min_by(" in line]
    assert chosen and not any(word in line for line in chosen for word in ("description", "attributes", "more fields"))
    assert {r.source_tool for r in counts.collect()} == {"mftecmd", "evtxecmd", "recmd", "lecmd"}
