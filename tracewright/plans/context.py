"""Per-finding context: priority numbers, evidence, edges, source and search hints.

A package is kept as tables keyed by finding. One document per finding has no
size bound, so one sink writes one JSON line per item, laid out by priority, and
the other nested documents that are closed at a size and go on in a numbered part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.labels import lookup
from tracewright.functions.text import clean
from tracewright.operators.ranking import number_rows
from tracewright.operators.running import PART, range_parts, running
from tracewright.operators.skew import salted_join, top_n
from tracewright.plans.lookups import incident_edges
from tracewright.session import cut_lineage

# Severity order of the work list, hint count.
SEVERITY_ORDER = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "UNASSESSED": 4, "LOW": 5, "INFO": 6, "UNKNOWN": 7}
MAX_HINTS = 30


def finding_priority(findings: DataFrame) -> DataFrame:
    """Findings numbered by severity, families, evidence and start."""
    return number_rows(
        findings,
        [
            lookup(SEVERITY_ORDER, F.col("severity"), 99),
            F.desc("independent_family_count"),
            F.desc("evidence_count"),
            F.coalesce(F.col("start_timestamp"), F.lit("")).asc(),
            F.col("finding_id").asc(),
        ],
        "priority",
    )


def source_context(findings: DataFrame, candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """Facts of the group a finding came from, by its kind."""
    facts = ["event_count", "edge_count", "start_ts", "end_ts", "relationship_types"]
    sides = candidates.select(
        F.lit("CANDIDATE_CLUSTER").alias("source_kind"), F.col("candidate_id").alias("source_id"),
        F.col("confidence").alias("source_confidence"), *facts,
    ).unionByName(
        clusters.select(
            F.lit("CORE_CLUSTER").alias("source_kind"), F.col("cluster_id").alias("source_id"),
            F.col("cluster_confidence").alias("source_confidence"), *facts,
        )
    )
    return findings.select("finding_id", "source_kind", "source_id").join(
        sides, ["source_kind", "source_id"], "left"
    )


def search_hints(
    findings: DataFrame, values: DataFrame, evidence: DataFrame, events: DataFrame, *, limit: int = MAX_HINTS
) -> DataFrame:
    """First distinct hints per finding, as (finding_id, position, hint).

    Order: title, type, rules, executables, then event fields in time order.
    Distinctness is a mergeable minimum over the order key; the rank limit then
    runs before its shuffle.
    """
    head = findings.select(
        "finding_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("level"), F.lit("").alias("sub"), F.col("title").alias("hint")),
                F.struct(F.lit(1).alias("level"), F.lit("").alias("sub"), F.col("finding_type").alias("hint")),
            )
        ).alias("h"),
    ).select("finding_id", "h.*")
    listed = values.filter(F.col("kind").isin("RULE", "EXECUTABLE")).select(
        "finding_id",
        F.when(F.col("kind") == "RULE", 2).otherwise(3).alias("level"),
        F.col("value").alias("sub"),
        F.col("value").alias("hint"),
    )
    event_id = F.when(
        F.col("windows_event_id") != "", F.concat(F.lit("Windows Event ID "), F.col("windows_event_id"))
    )
    parts = ["detection_rule", "executable", event_id, "provider", "channel", "registry_key"]
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), clean(part).alias("hint"))
            for i, part in enumerate(parts)
        ]
    )
    from_events = (
        evidence.select("finding_id", "event_uid")
        .join(events, "event_uid")
        .select("finding_id", "event_ts", "event_uid", F.explode(fields).alias("f"))
        .select(
            "finding_id",
            F.lit(4).alias("level"),
            F.concat_ws(
                "|", F.coalesce(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")),
                "event_uid", F.col("f.slot").cast("string"),
            ).alias("sub"),
            F.col("f.hint").alias("hint"),
        )
    )
    first = (
        head.unionByName(listed).unionByName(from_events)
        .withColumn("hint", clean("hint"))
        .filter(F.col("hint") != "")
        .groupBy("finding_id", "hint")
        .agg(F.min(F.struct("level", "sub")).alias("at"))
    )
    return top_n(first, ["finding_id"], [F.col("at").asc(), F.col("hint").asc()], limit, "position").select(
        "finding_id", "position", "hint"
    )


def context_items(
    findings: DataFrame,
    evidence: DataFrame,
    values: DataFrame,
    events: DataFrame,
    edges: DataFrame,
    candidates: DataFrame,
    clusters: DataFrame,
) -> DataFrame:
    """Package items: (priority, finding_id, section, sort_key, item JSON)."""
    numbered = cut_lineage(finding_priority(findings))
    keys = numbered.select("finding_id", "priority")
    # Rows of findings are given their priority while they are ids; items, which are long and many, are not joined again.
    evidence = cut_lineage(_with_priority(evidence, keys, ["event_uid"]))
    tagged = F.concat_ws("|", F.col("priority").cast("string"), F.col("finding_id"))
    header = numbered.select(
        "priority", "finding_id", F.lit("finding").alias("section"), F.lit("").alias("sort_key"),
        F.to_json(F.struct(*findings.columns)).alias("item"),
    )
    source = source_context(findings, candidates, clusters)
    source_rows = source.join(keys, "finding_id").select(
        "priority", "finding_id", F.lit("source_context").alias("section"), F.lit("").alias("sort_key"),
        F.to_json(F.struct(*[c for c in source.columns if c != "finding_id"])).alias("item"),
    )
    detailed = evidence.join(events, ["event_uid"]).drop(events["source_tool"])
    evidence_rows = detailed.select(
        "priority", "finding_id", F.lit("evidence").alias("section"),
        F.concat_ws("|", F.coalesce("timestamp", F.lit("")), "event_uid").alias("sort_key"),
        F.to_json(
            F.struct(
                "event_uid", "evidence_role", "evidence_family", "timestamp", "timestamp_type", "event_type",
                "hostname", "username", "executable", "path", "target_path", "windows_event_id", "channel",
                "detection_rule", "severity", "description", "attributes", "provenance",
            )
        ).alias("item"),
    )
    linked = incident_edges(edges, evidence.select(tagged.alias("finding_id"), "event_uid"))
    bar = F.instr("finding_id", "|")
    edge_rows = linked.select(
        F.substring("finding_id", F.lit(1), bar - 1).cast(dict(keys.dtypes)["priority"]).alias("priority"),
        F.substring("finding_id", bar + 1, F.length("finding_id")).alias("finding_id"), F.lit("correlation_edges").alias("section"),
        F.concat_ws("|", F.format_string("%.4f", 1 - F.col("score")), F.format_string("%020.6f", "time_delta_seconds"), "edge_uid").alias("sort_key"),
        F.to_json(F.struct(*[c for c in linked.columns if c != "finding_id"])).alias("item"),
    )
    value_rows = _with_priority(values, keys, ["kind", "value"]).select(
        "priority", "finding_id", F.concat(F.lit("values_"), F.lower("kind")).alias("section"),
        F.col("value").alias("sort_key"), F.to_json(F.struct("value")).alias("item"),
    )
    hints = search_hints(findings, values, evidence.drop("priority"), events).join(keys, "finding_id").select(
        "priority", "finding_id", F.lit("search_hints").alias("section"),
        F.format_string("%04d", "position").alias("sort_key"), F.to_json(F.struct("hint")).alias("item"),
    )
    rows = header
    for part in (source_rows, evidence_rows, edge_rows, value_rows, hints):
        rows = rows.unionByName(part)
    return rows


def _with_priority(rows: DataFrame, keys: DataFrame, salt_by: list[str]) -> DataFrame:
    return salted_join(rows, keys, ["finding_id"], salt_by=salt_by)


def write_context(items: DataFrame, path: str) -> None:
    """Write items range-partitioned by package and order, plus a flat index."""
    (
        items.repartitionByRange(F.col("priority"), F.col("section"), F.col("sort_key"))
        .sortWithinPartitions("priority", "section", "sort_key")
        .write.mode("errorifexists")
        .json(f"{path}/items")
    )
    index = items.groupBy("priority", "finding_id").agg(
        F.count_if(F.col("section") == "evidence").alias("evidence_count"),
        F.count_if(F.col("section") == "correlation_edges").alias("edge_count"),
    )
    index.write.mode("errorifexists").json(f"{path}/index")


PART_BYTES = 8 << 20  # of a package's items in one document


def package_parts(items: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """Nested packages: (priority, finding_id, part, bytes, items), each the next items of a finding in order.

    ``items`` is an array of (section, sort_key, item). A part is closed by the item that fills ``part_bytes``; the package goes on in
    the next number. Where items fall is told by running sums over ranges, so a finding of any size is never held by one task.
    """
    order = ["section", "sort_key", "item"]
    size = F.octet_length("item").cast("long")
    rows = items.select("priority", "finding_id", *order)
    parts = range_parts(rows, ["finding_id"], order)
    placed = running(parts, ["finding_id"], order, before=True, _before=("sum", size)).drop(PART)
    numbered = placed.withColumn("part", (F.floor(F.coalesce("_before", F.lit(0)) / part_bytes) + 1).cast("int"))
    return numbered.groupBy("priority", "finding_id", "part").agg(
        F.sum(size).alias("bytes"), F.array_sort(F.collect_list(F.struct(*order))).alias("items")
    )


def write_packages(items: DataFrame, path: str, *, part_bytes: int = PART_BYTES) -> None:
    """One JSON document per package part, and a flat index with the number of parts, items and links of every finding."""
    package_parts(items, part_bytes=part_bytes).write.mode("errorifexists").json(f"{path}/packages")
    written = items.sparkSession.read.json(f"{path}/packages", schema=PACKAGE_SCHEMA)
    of = lambda section: F.sum(F.size(F.filter("items", lambda i: i["section"] == section)))
    index = written.groupBy("priority", "finding_id").agg(
        F.max("part").alias("parts"), F.sum("bytes").alias("bytes"), F.sum(F.size("items")).alias("items"),
        of("evidence").alias("evidence_count"), of("correlation_edges").alias("edge_count"),
    )
    index.write.mode("errorifexists").json(f"{path}/index")


PACKAGE_SCHEMA = (
    "priority long, finding_id string, part int, bytes long, items array<struct<section: string, sort_key: string, item: string>>"
)


def read_packages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(package parts, index) of a folder that :func:`write_packages` has written."""
    counts = "priority long, finding_id string, parts int, bytes long, items long, evidence_count long, edge_count long"
    return spark.read.json(f"{path}/packages", schema=PACKAGE_SCHEMA), spark.read.json(f"{path}/index", schema=counts)
