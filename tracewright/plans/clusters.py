"""Core clusters with weak attachments, and candidate clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.components import connected_components
from tracewright.operators.skew import salted_join
from tracewright.schema import family_of
from tracewright.session import cut_lineage

# Versions and the relations a candidate may rest on.
CLUSTER_VERSION = "1.1"
CANDIDATE_VERSION = "1.1"
CANDIDATE_RELATIONS = ["SHARED_EXECUTABLE_NEAR_TIME", "SHARED_PATH_NEAR_TIME"]
STRONG = ["VERY_HIGH", "HIGH"]


def member_digest(uid: Column) -> list[Column]:
    """Aggregates that identify a set of uids whatever its size.

    Smallest uid, count and the sum of the leading 60 bits of each uid merge
    across partitions, so the identity of a huge cluster never needs its
    members in one place.
    """
    return [
        F.min(uid).alias("_low"),
        F.count(F.lit(1)).alias("_size"),
        F.sum(F.conv(F.substring(uid, 1, 15), 16, 10).cast("decimal(20,0)"))
        .cast("decimal(38,0)")
        .alias("_digest"),
    ]


def set_identity(*prefix: Column) -> Column:
    """Hash of a prefix and a member digest."""
    parts = [F.col(c).cast("string") for c in ("_low", "_size", "_digest")]
    return F.sha2(F.concat_ws("|", *prefix, *parts), 256)


def core_labels(edges: DataFrame) -> DataFrame:
    """(event_uid, core) over the strong edges."""
    strong = edges.filter(F.col("confidence").isin(STRONG))
    labels = connected_components(strong, "event_uid_a", "event_uid_b")
    return labels.select(F.col("node").alias("event_uid"), F.col("component").alias("core"))


def attach_weak_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each MEDIUM edge with its role against the cores.

    SAME_CORE adds an edge, ATTACHED also adds the outside node (a node may
    attach to several cores), CROSS_CORE and UNCLUSTERED add nothing.
    """
    weak = edges.filter(F.col("confidence") == "MEDIUM")
    a = labels.select(F.col("event_uid").alias("event_uid_a"), F.col("core").alias("core_a"))
    b = labels.select(F.col("event_uid").alias("event_uid_b"), F.col("core").alias("core_b"))
    placed = salted_join(weak, a, ["event_uid_a"], "left", salt_by=["edge_uid"])
    placed = salted_join(placed, b, ["event_uid_b"], "left", salt_by=["edge_uid"], counted=weak)
    in_a, in_b = F.col("core_a").isNotNull(), F.col("core_b").isNotNull()
    return placed.withColumn(
        "placement",
        F.when(in_a & in_b, F.when(F.col("core_a") == F.col("core_b"), "SAME_CORE").otherwise("CROSS_CORE"))
        .when(in_a | in_b, "ATTACHED")
        .otherwise("UNCLUSTERED"),
    ).withColumn(
        "core",
        F.when(F.col("placement").isin("SAME_CORE", "ATTACHED"), F.coalesce("core_a", "core_b")),
    ).withColumn(
        "attached_uid",
        F.when(
            F.col("placement") == "ATTACHED",
            F.when(in_a, F.col("event_uid_b")).otherwise(F.col("event_uid_a")),
        ),
    )


def build_clusters(
    events: DataFrame, edges: DataFrame, run_id: str, *, labels: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, cluster_events, cluster_edges)."""
    labels = cut_lineage(core_labels(edges)) if labels is None else labels
    ids = labels.groupBy("core").agg(*member_digest(F.col("event_uid"))).select(
        "core",
        set_identity(F.lit(run_id), F.lit(CLUSTER_VERSION)).alias("cluster_id"),
    )
    # From here on the cluster's id stands for the core: it is looked up for members, not for edges, which are many more.
    labels = cut_lineage(
        salted_join(labels, ids, ["core"], salt_by=["event_uid"]).select("event_uid", F.col("cluster_id").alias("core"))
    )
    placed = attach_weak_edges(edges, labels).filter(F.col("core").isNotNull())
    weak = cut_lineage(placed.select("core", "attached_uid", "edge_uid", "relationship_type", "confidence"))
    attached = (
        weak.filter(F.col("attached_uid").isNotNull())
        .select(F.col("attached_uid").alias("event_uid"), "core")
        .distinct()
        .withColumn("membership_role", F.lit("MEDIUM_ATTACHMENT"))
    )
    members = labels.withColumn("membership_role", F.lit("CORE")).unionByName(attached)
    strong = edges.filter(F.col("confidence").isin(STRONG))
    strong_placed = salted_join(
        strong.select("event_uid_a", "edge_uid", "relationship_type", "confidence"),
        labels.select(F.col("event_uid").alias("event_uid_a"), "core"),
        ["event_uid_a"],
        salt_by=["edge_uid"],
    )
    edge_columns = ["core", "edge_uid", "relationship_type", "confidence"]
    placed_edges = strong_placed.select(*edge_columns).unionByName(weak.select(*edge_columns))
    cluster_edges = cut_lineage(placed_edges.withColumnRenamed("core", "cluster_id"))

    facts = events.select("event_uid", "case_id", "source_tool", "event_ts")
    member_rows = cut_lineage(
        members.withColumnRenamed("core", "cluster_id").join(facts, "event_uid")
        .withColumn("evidence_family", family_of(F.col("source_tool")))
    )
    cluster_events = member_rows.select(
        "cluster_id", "event_uid", "source_tool", "evidence_family", "membership_role"
    )

    by_member = member_rows.groupBy("cluster_id").agg(
        F.min("case_id").alias("case_id"),
        F.min("event_ts").alias("start_ts"),
        F.max("event_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("source_tool")).alias("source_tools"),
        F.array_sort(F.collect_set("evidence_family")).alias("evidence_families"),
        F.max(F.col("source_tool") == "hayabusa").alias("has_detection"),
    )
    by_edge = cluster_edges.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.array_sort(F.collect_set("relationship_type")).alias("relationship_types"),
        F.max(F.col("confidence") == "MEDIUM").alias("_weak"),
    )
    clusters = by_member.join(by_edge, "cluster_id", "left").select(
        "cluster_id",
        F.lit(run_id).alias("cluster_run_id"),
        "case_id",
        F.when(F.coalesce("_weak", F.lit(False)), "HIGH").otherwise("VERY_HIGH").alias("cluster_confidence"),
        "start_ts",
        "end_ts",
        "event_count",
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.size("evidence_families").cast("long").alias("independent_family_count"),
        "source_tools",
        "evidence_families",
        F.coalesce("relationship_types", F.array().cast("array<string>")).alias("relationship_types"),
        "has_detection",
    )
    return clusters, cluster_events, cluster_edges


def independent_weak_edges(edges: DataFrame) -> DataFrame:
    """MEDIUM key-sharing edges between different evidence families."""
    return edges.filter(
        (F.col("confidence") == "MEDIUM")
        & (family_of(F.col("source_tool_a")) != family_of(F.col("source_tool_b")))
        & F.col("relationship_type").isin(CANDIDATE_RELATIONS)
    )


def build_candidates(
    events: DataFrame, edges: DataFrame, run_id: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, candidate_events, candidate_edges, candidate_keys).

    ``candidate_keys`` holds the distinct shared values as rows
    (candidate_id, kind, value): a hot candidate has no bound on their number.
    """
    weak = independent_weak_edges(edges)
    labels = cut_lineage(
        connected_components(weak, "event_uid_a", "event_uid_b").select(
            F.col("node").alias("event_uid"), F.col("component").alias("core")
        )
    )
    facts = events.select("event_uid", "case_id", "source_tool", "event_ts")
    rows = cut_lineage(
        labels.join(facts, "event_uid").withColumn("evidence_family", family_of(F.col("source_tool")))
    )
    rolled = cut_lineage(
        rows.groupBy("core")
        .agg(
            *member_digest(F.col("event_uid")),
            F.min("case_id").alias("case_id"),
            F.min("event_ts").alias("start_ts"),
            F.max("event_ts").alias("end_ts"),
            F.array_sort(F.collect_set("source_tool")).alias("source_tools"),
            F.array_sort(F.collect_set("evidence_family")).alias("evidence_families"),
        )
        .filter(F.size("evidence_families") >= 2)
        .withColumn("candidate_id", set_identity(F.lit(run_id), F.lit(CANDIDATE_VERSION)))
    )
    ids = rolled.select("core", "candidate_id")
    candidate_events = cut_lineage(salted_join(rows, ids, ["core"], salt_by=["event_uid"]).select(
        "candidate_id", "event_uid", "source_tool", "evidence_family"
    ))
    # A node is of one candidate, so edges find theirs by an end.
    placed = cut_lineage(salted_join(
        weak.select("event_uid_a", "edge_uid", "relationship_type", "confidence", "shared_keys"),
        candidate_events.select(F.col("event_uid").alias("event_uid_a"), "candidate_id"),
        ["event_uid_a"],
        salt_by=["edge_uid"],
    ).drop("event_uid_a"))
    candidate_edges = placed.select("candidate_id", "edge_uid", "relationship_type", "confidence")
    candidate_keys = (
        placed.select("candidate_id", F.explode("shared_keys").alias("kind", "values"))
        .select("candidate_id", "kind", F.explode("values").alias("value"))
        .withColumn("value", F.lower(F.trim("value")))
        .filter(F.col("value") != "")
        .distinct()
    )
    by_edge = candidate_edges.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.array_sort(F.collect_set("relationship_type")).alias("relationship_types"),
    )
    candidates = rolled.join(by_edge, "candidate_id").select(
        "candidate_id",
        F.lit(run_id).alias("correlation_run_id"),
        "case_id",
        F.lit("MEDIUM").alias("confidence"),
        F.col("_size").alias("event_count"),
        "edge_count",
        F.size("evidence_families").cast("long").alias("independent_family_count"),
        "start_ts",
        "end_ts",
        "source_tools",
        "evidence_families",
        "relationship_types",
    )
    return candidates, candidate_events, candidate_edges, candidate_keys


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Counts by confidence, by relation and by unordered tool pair, and the
    largest degree, as (metric, label, n). One pass feeds the three groupings."""
    pair = F.concat_ws(
        "|",
        F.least("source_tool_a", "source_tool_b"),
        F.greatest("source_tool_a", "source_tool_b"),
    )
    labels = F.array(
        F.struct(F.lit("confidence").alias("metric"), F.col("confidence").alias("label")),
        F.struct(F.lit("relationship").alias("metric"), F.col("relationship_type").alias("label")),
        F.struct(F.lit("tool_pair").alias("metric"), pair.alias("label")),
    )
    counts = (
        edges.select(F.explode(labels).alias("x"))
        .groupBy("x.metric", "x.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = (
        node_degrees(edges)
        .agg(F.max("degree").alias("n"))
        .select(
            F.lit("max_degree").alias("metric"), F.lit("").alias("label"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
    return counts.unionByName(top)


def edge_counts(edges: DataFrame) -> DataFrame:
    """(relationship_type, confidence, n, mean_score)."""
    return edges.groupBy("relationship_type", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """(event_uid, degree)."""
    return (
        edges.select(F.explode(F.array("event_uid_a", "event_uid_b")).alias("event_uid"))
        .groupBy("event_uid")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
