"""Items of context packages: their priority comes with the ids, not by a join of the items."""

from pyspark.sql import functions as F

from tracewright.registry import catalog


def test_items_are_not_joined_again(spark):
    sf = "/root/testdata/sf0.001"
    queries = catalog.queries()
    items = queries["context_package"](spark, sf)
    assert items.columns == ["priority", "finding_id", "section", "sort_key", "item"]
    assert items._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    want = {(r.finding_id, r.priority) for r in queries["finding_priority"](spark, sf).collect()}
    assert {(r.finding_id, r.priority) for r in items.select("finding_id", "priority").distinct().collect()} == want
    found = queries["incident_edges"](spark, sf).groupBy("finding_id").count()
    listed = items.filter("section = 'correlation_edges'").groupBy("finding_id").agg(F.count("item").alias("count"))
    assert {tuple(r) for r in listed.collect()} == {tuple(r) for r in found.collect()}
