"""Registered queries: findings, routing, context, synthesis and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.functions.text import clean
from tracewright.functions.times import format_ts
from tracewright.operators.ranking import budget_prefix
from tracewright.plans import context as X
from tracewright.plans import findings as P
from tracewright.plans import lookups as L
from tracewright.plans import quality as Q
from tracewright.plans import report as R
from tracewright.plans import routing as T
from tracewright.plans import synthesis as S
from tracewright.plans.ingest import missing_events
from tracewright.registry.base import query
from tracewright.registry.graph import CANDIDATES_CTE, CLUSTERS_CTE, EDGES_CTE, RUN, staged_graph
from tracewright.registry.views import staged, table
from tracewright.session import cut_lineage, ensure_checkpoint_dir


def finding_tables(spark, sf_dir):
    """Findings, evidence and values as written stage tables."""
    events, _, (clusters, cluster_events, _), (candidates, candidate_events, _, keys) = staged_graph(spark, sf_dir)

    def build():
        made = P.build_findings(events, clusters, cluster_events, candidates, candidate_events, keys, RUN)
        return [cut_lineage(t) for t in made]

    return staged(spark, sf_dir, "findings", build)


SUPPRESS_CTE = (
    CANDIDATES_CTE
    + r""",
strong_clusters AS (SELECT cluster_id FROM clusters WHERE independent_family_count >= 2),
sizes AS (SELECT candidate_id, count(*) AS n FROM cand_events GROUP BY 1),
covered AS (
  SELECT DISTINCT candidate_id FROM (
    SELECT c.candidate_id, k.cluster_id, count(*) AS shared FROM cand_events c JOIN cl_events k USING (event_uid)
    WHERE k.cluster_id IN (SELECT cluster_id FROM strong_clusters) GROUP BY 1, 2) JOIN sizes USING (candidate_id) WHERE shared = n),
det AS (
  SELECT cluster_id, max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'crit' THEN 4 ELSE -1 END) AS rank,
    count(DISTINCT detection_rule) AS rules, min(detection_rule) AS first_rule
  FROM cl_events WHERE source_tool = 'hayabusa' GROUP BY 1),
core_names AS (
  SELECT cluster_id, min(v) AS name FROM (
    SELECT cluster_id, executable AS v FROM cl_events WHERE executable <> ''
    UNION ALL SELECT cluster_id, 'app' || regexp_extract(path, 'APP(\d+)\.EXE-', 1) || '.exe' FROM cl_events WHERE path LIKE '%.pf') GROUP BY 1),
cand_names AS (
  SELECT candidate_id, count(*) AS n, min(v) AS name FROM (
    SELECT DISTINCT c.candidate_id, 'app' || CAST(u AS VARCHAR) || '.exe' AS v FROM cand_events c
    WHERE candidate_id IN (SELECT candidate_id FROM cand_edges WHERE relationship_type = 'SHARED_EXECUTABLE_NEAR_TIME')) GROUP BY 1),
findings AS (
  SELECT sha256('1.7|CROSS_ARTIFACT_ACTIVITY_LEAD|' || candidate_id) AS finding_id, 'CROSS_ARTIFACT_ACTIVITY_LEAD' AS finding_type, 'MEDIUM' AS confidence,
    'UNASSESSED' AS severity, 'Cross-artifact activity correlation' || CASE WHEN n.n = 1 THEN ': ' || n.name ELSE '' END AS title,
    candidate_id AS source_id, start_timestamp, end_timestamp, independent_family_count, event_count AS evidence_count
  FROM candidates LEFT JOIN cand_names n USING (candidate_id) WHERE candidate_id NOT IN (SELECT candidate_id FROM covered)
  UNION ALL SELECT sha256('1.7|CORE_CROSS_ARTIFACT_LEAD|' || cluster_id), 'CORE_CROSS_ARTIFACT_LEAD', 'HIGH', 'UNASSESSED',
    'Cross-artifact forensic lead' || coalesce(': ' || n.name, ''), cluster_id, start_timestamp, end_timestamp, independent_family_count, event_count
  FROM clusters LEFT JOIN core_names n USING (cluster_id) WHERE independent_family_count >= 2
  UNION ALL SELECT sha256('1.7|HAYABUSA_DETECTION_LEAD|' || cluster_id), 'HAYABUSA_DETECTION_LEAD', 'HIGH',
    CASE rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' ELSE 'MEDIUM' END,
    'Detection lead: ' || first_rule || CASE WHEN rules > 1 THEN ' (+' || CAST(rules - 1 AS VARCHAR) || ' related)' ELSE '' END,
    cluster_id, start_timestamp, end_timestamp, independent_family_count, event_count
  FROM clusters JOIN det USING (cluster_id) WHERE rank >= 2),
evidence AS (
  SELECT sha256('1.7|CROSS_ARTIFACT_ACTIVITY_LEAD|' || candidate_id) AS finding_id, event_uid,
    CASE family WHEN 'PREFETCH' THEN 'EXECUTION_EVIDENCE' ELSE 'FILESYSTEM_EVIDENCE' END AS evidence_role
  FROM cand_events WHERE candidate_id NOT IN (SELECT candidate_id FROM covered)
  UNION ALL SELECT sha256('1.7|CORE_CROSS_ARTIFACT_LEAD|' || cluster_id), event_uid,
    CASE WHEN source_tool = 'hayabusa' THEN 'DETECTION_ENRICHMENT' WHEN membership_role = 'CORE' THEN 'CORE_EVIDENCE' ELSE 'CORROBORATING_ATTACHMENT' END
  FROM cl_events WHERE cluster_id IN (SELECT cluster_id FROM strong_clusters)
  UNION ALL SELECT sha256('1.7|HAYABUSA_DETECTION_LEAD|' || cluster_id), event_uid,
    CASE WHEN source_tool = 'hayabusa' THEN 'DETECTION_ENRICHMENT' ELSE 'UNDERLYING_EVTX' END
  FROM cl_events WHERE cluster_id IN (SELECT cluster_id FROM det WHERE rank >= 2))
"""
)
FINDING_COLUMNS = [
    "finding_id", "finding_type", "confidence", "severity", "title", "source_id", "start_timestamp", "end_timestamp",
    "independent_family_count", "evidence_count",
]


@query("candidate_suppression", f"WITH RECURSIVE {SUPPRESS_CTE} SELECT candidate_id FROM covered")
def candidate_suppression(spark, sf_dir):
    _, _, (clusters, cluster_events, _), (_, candidate_events, _, _) = staged_graph(spark, sf_dir)
    return P.covered_candidates(candidate_events, clusters, cluster_events)


@query("findings", f"WITH RECURSIVE {SUPPRESS_CTE} SELECT {', '.join(FINDING_COLUMNS)} FROM findings")
def findings(spark, sf_dir):
    return finding_tables(spark, sf_dir)[0].select(*FINDING_COLUMNS)


@query("finding_evidence", f"WITH RECURSIVE {SUPPRESS_CTE} SELECT finding_id, event_uid, evidence_role FROM evidence")
def finding_evidence(spark, sf_dir):
    return finding_tables(spark, sf_dir)[1].select("finding_id", "event_uid", "evidence_role")


@query(
    "detection_leads",
    f"""WITH RECURSIVE {SUPPRESS_CTE} SELECT cluster_id, rank, rules AS rule_count, first_rule FROM det""",
)
def detection_leads(spark, sf_dir):
    events, _, (_, cluster_events, _), _ = staged_graph(spark, sf_dir)
    rolled, _ = P.detection_rollup(events, cluster_events)
    return rolled.select("cluster_id", F.col("rank").cast("int").alias("rank"), "rule_count", "first_rule")


@query(
    "detection_severities",
    f"""WITH RECURSIVE {CLUSTERS_CTE} SELECT CASE severity WHEN 'info' THEN 'INFO' WHEN 'low' THEN 'LOW' WHEN 'medium' THEN 'MEDIUM'
    WHEN 'high' THEN 'HIGH' WHEN 'crit' THEN 'CRITICAL' ELSE 'UNKNOWN' END AS severity, count(*) AS n
    FROM ev WHERE source_tool = 'hayabusa' AND event_uid IN (SELECT event_uid FROM cl_events) GROUP BY 1""",
)
def detection_severities(spark, sf_dir):
    events, _, (_, cluster_events, _), _ = staged_graph(spark, sf_dir)
    return P.detection_severities(events, cluster_events.select("event_uid"))


@query("linked_evidence", f"WITH RECURSIVE {SUPPRESS_CTE} SELECT count(*) AS links FROM evidence")
def linked_evidence(spark, sf_dir):
    found, evidence, _ = finding_tables(spark, sf_dir)
    return P.linked_evidence_count(found, evidence)


@query(
    "finding_counts",
    f"""WITH RECURSIVE {SUPPRESS_CTE} SELECT 'finding_type' AS metric, finding_type AS label, count(*) AS n FROM findings GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY 2""",
)
def finding_counts(spark, sf_dir):
    return R.finding_counts(finding_tables(spark, sf_dir)[0])


_SEVERITY_SQL = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'UNASSESSED' THEN 4 ELSE 9 END"


@query(
    "finding_priority",
    f"""WITH RECURSIVE {SUPPRESS_CTE} SELECT finding_id, row_number() OVER (ORDER BY {_SEVERITY_SQL}, independent_family_count DESC,
    evidence_count DESC, start_timestamp, finding_id) AS priority FROM findings""",
)
def finding_priority(spark, sf_dir):
    return X.finding_priority(finding_tables(spark, sf_dir)[0]).select("finding_id", "priority")


@query(
    "top_findings",
    f"""WITH RECURSIVE {SUPPRESS_CTE} SELECT finding_id, severity, title FROM findings ORDER BY {_SEVERITY_SQL}, independent_family_count DESC,
    evidence_count DESC, start_timestamp, finding_id LIMIT 25""",
)
def top_findings(spark, sf_dir):
    return R.top_findings(finding_tables(spark, sf_dir)[0], X.SEVERITY_ORDER).select("finding_id", "severity", "title")


@query(
    "incident_edges",
    f"""WITH RECURSIVE {SUPPRESS_CTE} SELECT DISTINCT v.finding_id, e.edge_uid, e.score FROM edges e
    JOIN evidence v ON v.event_uid = e.event_uid_a OR v.event_uid = e.event_uid_b""",
)
def incident_edges(spark, sf_dir):
    _, edges, _, _ = staged_graph(spark, sf_dir)
    return L.incident_edges(edges, finding_tables(spark, sf_dir)[1]).select("finding_id", "edge_uid", "score")


@query(
    "incident_edges_hub",
    f"""WITH RECURSIVE {SUPPRESS_CTE}, h AS (SELECT edge_uid, score, CASE WHEN left(edge_uid, 1) < '6' THEN 'HUB' ELSE event_uid_a END AS a, event_uid_b AS b FROM edges),
    held AS (SELECT finding_id, event_uid FROM evidence UNION SELECT finding_id, 'HUB' FROM evidence)
    SELECT DISTINCT v.finding_id, e.edge_uid, e.score FROM h e JOIN held v ON v.event_uid = e.a OR v.event_uid = e.b""",
)
def incident_edges_hub(spark, sf_dir):
    """One event is an end of a third of all edges and in every finding."""
    _, edges, _, _ = staged_graph(spark, sf_dir)
    hub = F.when(F.substring("edge_uid", 1, 1) < "6", "HUB").otherwise(F.col("event_uid_a"))
    evidence = finding_tables(spark, sf_dir)[1].select("finding_id", "event_uid")
    held = evidence.unionByName(evidence.select("finding_id", F.lit("HUB").alias("event_uid")))
    found = L.incident_edges(edges.withColumn("event_uid_a", hub), held, rows_per_salt=200, min_bytes=0)
    return found.select("finding_id", "edge_uid", "score")


@query(
    "source_context",
    f"""WITH RECURSIVE {SUPPRESS_CTE}, src AS (SELECT true AS cand, candidate_id AS source_id, event_count, edge_count FROM candidates
      UNION ALL SELECT false, cluster_id, event_count, edge_count FROM clusters)
    SELECT f.finding_id, f.source_id, s.event_count, s.edge_count FROM findings f
    LEFT JOIN src s ON s.source_id = f.source_id AND s.cand = (f.finding_type = 'CROSS_ARTIFACT_ACTIVITY_LEAD')""",
)
def source_context(spark, sf_dir):
    _, _, (clusters, _, _), (candidates, _, _, _) = staged_graph(spark, sf_dir)
    found = finding_tables(spark, sf_dir)[0]
    return X.source_context(found, candidates, clusters).select("finding_id", "source_id", "event_count", "edge_count")


@query(
    "context_parts",
    f"""WITH RECURSIVE {SUPPRESS_CTE}, i AS (SELECT finding_id, 'evidence' AS section, event_uid AS item FROM evidence UNION ALL SELECT finding_id, 'finding', title FROM findings),
    r AS (SELECT *, strlen(item) AS size, sum(strlen(item)) OVER (PARTITION BY finding_id ORDER BY section, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
    p AS (SELECT *, CAST(floor(coalesce(before, 0) / 600) AS INTEGER) + 1 AS part FROM r)
    SELECT p.finding_id, part, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n, min(item) FILTER (section = 'evidence') AS first, x.parts, x.evidence_count FROM p JOIN
      (SELECT finding_id, max(part) AS parts, count(*) FILTER (section = 'evidence') AS evidence_count FROM p GROUP BY 1) x USING (finding_id) GROUP BY ALL""",
)
def context_parts(spark, sf_dir):
    """Packages of findings with their events, written in parts of 600 bytes and read back with the index."""
    found, evidence, _ = finding_tables(spark, sf_dir)
    rows = evidence.select("finding_id", F.lit("evidence").alias("section"), F.col("event_uid").alias("item")).unionByName(
        found.select("finding_id", F.lit("finding").alias("section"), F.col("title").alias("item"))
    )
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packages/{uuid.uuid4().hex}"
    X.write_packages(rows.withColumn("priority", F.lit(1).cast("long")).withColumn("sort_key", F.lit("")), folder, part_bytes=600)
    packages, index = X.read_packages(spark, folder)
    first = F.array_min(F.transform(F.filter("items", lambda i: i["section"] == "evidence"), lambda i: i["item"]))
    return packages.join(index.select("finding_id", "parts", "evidence_count"), "finding_id").select(
        "finding_id", "part", "bytes", F.size("items").cast("long").alias("n"), first.alias("first"), "parts", "evidence_count"
    )


@query("context_package")
def context_package(spark, sf_dir):
    events, edges, (clusters, _, _), (candidates, _, _, _) = staged_graph(spark, sf_dir)
    found, evidence, values = finding_tables(spark, sf_dir)
    return X.context_items(found, evidence, values, events, edges, candidates, clusters)


@query("search_hints")
def search_hints(spark, sf_dir):
    events, *_ = staged_graph(spark, sf_dir)
    found, evidence, values = finding_tables(spark, sf_dir)
    return X.search_hints(found, values, evidence, events)


@query("finding_search_queries")
def finding_search_queries(spark, sf_dir):
    from tracewright.plans.retrieval import finding_search_queries as build

    found, _, values = finding_tables(spark, sf_dir)
    return build(found, values)


@query(
    "integrity_checks",
    f"""WITH {EDGES_CTE} SELECT 'duplicate_uid' AS "check", count(*) - count(DISTINCT event_uid) AS bad_rows FROM ev
    UNION ALL SELECT 'missing_provenance', 0 UNION ALL SELECT 'unreadable_time', 0
    UNION ALL SELECT 'self_edge', count(*) FILTER (event_uid_a = event_uid_b) FROM edges
    UNION ALL SELECT 'duplicate_edge', count(*) - count(DISTINCT edge_uid) FROM edges UNION ALL SELECT 'missing_event', 0""",
)
def integrity_checks(spark, sf_dir):
    events, edges, _, _ = staged_graph(spark, sf_dir)
    return Q.event_checks(events).unionByName(Q.edge_checks(edges, events))


@query(
    "integrity_dirty",
    """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber % 3 AS VARCHAR) AS uid, l_linenumber AS n FROM lineitem),
    g AS (SELECT CAST(o_custkey AS VARCHAR) AS edge, CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_custkey % 3 AS VARCHAR) AS a,
      CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_orderkey % 3 AS VARCHAR) AS b FROM orders)
    SELECT 'duplicate_uid' AS "check", (SELECT count(*) FROM (SELECT uid FROM e GROUP BY uid HAVING count(*) > 1)) AS bad_rows
    UNION ALL SELECT 'missing_provenance', (SELECT count(*) FROM e WHERE n % 4 = 0)
    UNION ALL SELECT 'unreadable_time', (SELECT count(*) FROM e WHERE n % 5 = 0)
    UNION ALL SELECT 'self_edge', (SELECT count(*) FROM g WHERE a = b)
    UNION ALL SELECT 'duplicate_edge', (SELECT count(*) FROM (SELECT edge FROM g GROUP BY edge HAVING count(*) > 1))
    UNION ALL SELECT 'missing_event', (SELECT count(*) FROM (SELECT a AS uid FROM g UNION SELECT b FROM g) WHERE uid NOT IN (SELECT uid FROM e))""",
)
def integrity_dirty(spark, sf_dir):
    """The checks over rows that break every rule."""
    text = lambda c: F.col(c).cast("string")
    number = F.col("l_linenumber")
    events = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", text("l_orderkey"), (number % 3).cast("string")).alias("event_uid"),
        F.when(number % 4 != 0, F.struct(number.alias("source_row"))).alias("provenance"),
        F.when(number % 5 != 0, F.col("l_shipdate")).alias("event_ts"),
    )
    edges = table(spark, sf_dir, "orders").select(
        text("o_custkey").alias("edge_uid"),
        F.concat_ws("-", text("o_orderkey"), (F.col("o_custkey") % 3).cast("string")).alias("event_uid_a"),
        F.concat_ws("-", text("o_orderkey"), (F.col("o_orderkey") % 3).cast("string")).alias("event_uid_b"),
    )
    return Q.event_checks(events).unionByName(Q.edge_checks(edges, events))


@query(
    "missing_rows_anti",
    "SELECT CAST(doc_id AS VARCHAR) AS event_uid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_rows_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("event_uid"), "lang",
        F.struct(F.col("doc_id").alias("source_row")).alias("provenance"), F.lit("").alias("timestamp"),
    )
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("event_uid"))
    return missing_events(docs, stored).select("event_uid", "lang")


# Orders stand in for findings, their lines for evidence.
TITLES = [
    "Service installed", "RDP session", "Admin group change", "Firewall rule change", "Odd file", "Password reset", "WMI call",
]
ORDER_FINDINGS_SQL = """
  SELECT 'F' || CAST(o_orderkey AS VARCHAR) AS finding_id, o_orderkey AS seq,
    (['Service installed','RDP session','Admin group change','Firewall rule change','Odd file','Password reset','WMI call'])[CAST(o_custkey % 7 + 1 AS INTEGER)] AS title,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'UNASSESSED' ELSE 'LOW' END AS severity,
    o_custkey % 3 AS independent_family_count, o_orderstatus AS st
  FROM orders"""
ORDER_CTE = f"""of AS ({ORDER_FINDINGS_SQL}),
  ou AS (SELECT 'F' || CAST(l_orderkey AS VARCHAR) AS finding_id, 'P' || CAST(l_partkey AS VARCHAR) AS event_uid, 'L' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_uid,
    l_shipdate AS ts, l_linenumber AS ln FROM lineitem),
  oc AS (SELECT of.*, coalesce(c.n, 0) AS evidence_count FROM of LEFT JOIN (SELECT finding_id, count(*) AS n FROM ou GROUP BY 1) c USING (finding_id))"""


def order_findings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rank = F.left("o_orderpriority", F.lit(1))
    severity = (
        F.when(rank == "1", "CRITICAL").when(rank == "2", "HIGH").when(rank == "3", "MEDIUM")
        .when(rank == "4", "UNASSESSED").otherwise("LOW")
    )
    return orders.select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("finding_id"),
        F.col("o_orderkey").alias("seq"),
        F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("o_custkey") % 7 + 1).cast("int")).alias("title"),
        severity.alias("severity"),
        (F.col("o_custkey") % 3).alias("independent_family_count"),
        F.col("o_orderstatus").alias("st"),
        F.lit("HIGH").alias("confidence"), F.lit("DEMO_LEAD").alias("finding_type"),
        format_ts(F.col("o_orderdate")).alias("start_timestamp"), format_ts(F.col("o_orderdate")).alias("end_timestamp"),
    )


def order_uids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat(F.lit("F"), F.col("l_orderkey").cast("string")).alias("finding_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("event_uid"),
    )


def order_line_uids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    uid = F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return lines.select(
        F.concat(F.lit("F"), F.col("l_orderkey").cast("string")).alias("finding_id"), uid.alias("event_uid"),
        F.col("l_shipdate").alias("event_ts"), F.col("l_linenumber").alias("ln"),
    )


def counted_order_findings(spark, sf_dir):
    counts = order_uids(spark, sf_dir).groupBy("finding_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    return order_findings(spark, sf_dir).join(counts, "finding_id", "left").withColumn(
        "evidence_count", F.coalesce("evidence_count", F.lit(0))
    )


ROUTES_CTE = (
    ORDER_CTE
    + """, routes AS (SELECT finding_id, severity, evidence_count,
      CASE severity WHEN 'CRITICAL' THEN 120 WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 50 WHEN 'UNASSESSED' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END
        + CASE WHEN independent_family_count >= 2 THEN 25 ELSE 0 END + CASE WHEN evidence_count >= 10 THEN 5 ELSE 0 END AS routing_score,
      CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'DEEP_8B' WHEN independent_family_count >= 2 OR severity = 'MEDIUM' THEN 'FAST_4B' ELSE 'STORE_ONLY' END AS planned_route,
      CASE WHEN st = 'P' THEN 'ANALYZED_8B' ELSE 'PENDING' END AS status, st, seq FROM oc)"""
)


def demo_routes(spark, sf_dir):
    found = counted_order_findings(spark, sf_dir)
    return T.route_findings(found, found.filter(F.col("st") == "P").select("finding_id"), RUN)


@query("route_findings", f"WITH {ROUTES_CTE} SELECT finding_id, routing_score, planned_route, status FROM routes")
def route_findings(spark, sf_dir):
    return demo_routes(spark, sf_dir).select("finding_id", "routing_score", "planned_route", "status")


@query("route_counts", f"WITH {ROUTES_CTE} SELECT planned_route, status, count(*) AS n FROM routes GROUP BY 1, 2")
def route_counts(spark, sf_dir):
    return T.route_counts(demo_routes(spark, sf_dir))


@query(
    "top_pending",
    f"""WITH {ROUTES_CTE} SELECT finding_id, planned_route, routing_score, evidence_count FROM routes WHERE status = 'PENDING'
    ORDER BY CASE planned_route WHEN 'DEEP_8B' THEN 1 WHEN 'FAST_4B' THEN 2 ELSE 3 END, routing_score DESC, evidence_count DESC, finding_id LIMIT 20""",
)
def top_pending(spark, sf_dir):
    return T.top_pending(demo_routes(spark, sf_dir)).select("finding_id", "planned_route", "routing_score", "evidence_count")


@query(
    "status_transition",
    f"""WITH {ROUTES_CTE} SELECT r.finding_id, CASE WHEN l.toxic = 1 THEN 'ANALYZED_8B' WHEN planned_route = 'FAST_4B' AND l.doc_id IS NOT NULL
      THEN CASE WHEN l.quality = 0 THEN 'ESCALATE_8B' ELSE 'FAST_4B_COMPLETE' END ELSE status END AS status
    FROM routes r LEFT JOIN labels l ON r.seq = l.doc_id""",
)
def status_transition(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("finding_id", F.concat(F.lit("F"), F.col("doc_id").cast("string")))
    fast = labels.select("finding_id", (F.col("quality") == 0).alias("escalate"))
    deep = labels.filter(F.col("toxic") == 1).select("finding_id")
    return T.apply_results(demo_routes(spark, sf_dir), fast, deep).select("finding_id", "status")


@query(
    "deep_selection",
    f"""WITH {ROUTES_CTE} SELECT finding_id, routing_score FROM routes WHERE planned_route = 'DEEP_8B' AND status = 'PENDING'
    AND finding_id NOT IN (SELECT 'F' || CAST(doc_id AS VARCHAR) FROM labels)""",
)
def deep_selection(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("finding_id"))
    return T.deep_selection(demo_routes(spark, sf_dir), done).select("finding_id", "routing_score")


RESOLVED_CTE = """docs AS (SELECT d.doc_id, d.source, l.doc_id AS lid, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
  resolved AS (SELECT doc_id AS finding_id, CASE WHEN toxic = 1 THEN 'QWEN3_8B_DEEP' WHEN lid IS NOT NULL THEN 'QWEN3_4B_FAST' ELSE 'NONE' END AS ai_source,
    CASE WHEN toxic = 1 THEN 'SUSPICIOUS' WHEN quality = 0 THEN 'NEEDS_REVIEW' WHEN quality = 1 THEN 'LIKELY_BENIGN' ELSE 'INSUFFICIENT_EVIDENCE' END AS assessment,
    CASE WHEN toxic = 1 THEN 'HIGH' WHEN lid IS NOT NULL THEN 'LOW' ELSE 'MEDIUM' END AS ai_priority,
    coalesce((SELECT least(count(*), 4) FROM conversations c WHERE c.conv_id = docs.doc_id), 0) AS historical_reference_count FROM docs)"""


def demo_resolved(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "finding_id")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("finding_id"), F.col("source").alias("title"), F.lit("DEMO_LEAD").alias("finding_type"),
        F.lit("MEDIUM").alias("severity"), F.lit("LOW").alias("confidence"),
    )
    deep = labels.filter(F.col("toxic") == 1).select(
        "finding_id", F.lit("SUSPICIOUS").alias("assessment"), F.lit("HIGH").alias("priority"), F.lit("HIGH").alias("confidence")
    )
    fast = labels.select(
        "finding_id", F.when(F.col("quality") == 0, "NEEDS_REVIEW").otherwise("LIKELY_BENIGN").alias("assessment"),
        F.lit("LOW").alias("priority"), F.lit("LOW").alias("confidence"),
    )
    references = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("finding_id"))
    return S.results_by_precedence(docs, deep, fast, references)


@query(
    "status_precedence",
    f"WITH {RESOLVED_CTE} SELECT finding_id, ai_source, assessment, ai_priority, historical_reference_count FROM resolved",
)
def status_precedence(spark, sf_dir):
    return demo_resolved(spark, sf_dir).select(
        "finding_id", "ai_source", "assessment", "ai_priority", "historical_reference_count"
    )


@query(
    "overall_assessment",
    f"""WITH {RESOLVED_CTE} SELECT CASE WHEN count(*) FILTER (assessment = 'SUSPICIOUS') > 0 THEN 'SUSPICIOUS' ELSE 'NEEDS_REVIEW' END AS overall_assessment,
    CASE WHEN count(*) FILTER (ai_priority = 'HIGH') > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS overall_priority,
    CASE WHEN count(*) FILTER (ai_source = 'QWEN3_8B_DEEP') > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS overall_confidence,
    count(*) FILTER (ai_source = 'QWEN3_8B_DEEP') AS deep_count, count(*) FILTER (ai_source = 'QWEN3_4B_FAST') AS fast_count,
    count(*) FILTER (ai_source = 'NONE') AS none_count, count(*) AS finding_count FROM resolved""",
)
def overall_assessment(spark, sf_dir):
    return S.overall(demo_resolved(spark, sf_dir))


@query(
    "assessment_distribution",
    f"""WITH {RESOLVED_CTE} SELECT p AS position, a AS assessment, count(r.finding_id) AS n FROM (VALUES (0,'HIGH_PRIORITY_REVIEW'),(1,'SUSPICIOUS'),
    (2,'NEEDS_REVIEW'),(3,'INSUFFICIENT_EVIDENCE'),(4,'LIKELY_BENIGN')) v(p, a) LEFT JOIN resolved r ON r.assessment = v.a GROUP BY 1, 2""",
)
def assessment_distribution(spark, sf_dir):
    return R.assessment_distribution(demo_resolved(spark, sf_dir))


@query(
    "key_findings",
    f"""WITH {RESOLVED_CTE}, rk AS (SELECT *, CASE assessment WHEN 'SUSPICIOUS' THEN 4 WHEN 'NEEDS_REVIEW' THEN 3 WHEN 'INSUFFICIENT_EVIDENCE' THEN 2 ELSE 1 END AS assessment_rank,
      CASE ai_priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS priority_rank, coalesce(n, 0) AS uid_count
      FROM resolved LEFT JOIN (SELECT l_partkey AS finding_id, count(*) AS n FROM lineitem GROUP BY 1) USING (finding_id))
    SELECT finding_id, assessment_rank, priority_rank, uid_count FROM rk""",
)
def key_findings(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("finding_id")).agg(
        F.count(F.lit(1)).alias("uid_count")
    )
    ranked = S.ranked_findings(demo_resolved(spark, sf_dir), counts)
    return ranked.select("finding_id", "assessment_rank", "priority_rank", "uid_count")


@query(
    "grounding_statistics",
    f"""WITH {RESOLVED_CTE} SELECT 'findings' AS metric, count(*) AS n FROM resolved
    UNION ALL SELECT 'deep', count(*) FILTER (ai_source = 'QWEN3_8B_DEEP') FROM resolved
    UNION ALL SELECT 'fast', count(*) FILTER (ai_source = 'QWEN3_4B_FAST') FROM resolved
    UNION ALL SELECT 'none', count(*) FILTER (ai_source = 'NONE') FROM resolved
    UNION ALL SELECT 'with_references', count(*) FILTER (historical_reference_count > 0) FROM resolved
    UNION ALL SELECT 'unique_event_uids', count(DISTINCT l_partkey) FROM lineitem""",
)
def grounding_statistics(spark, sf_dir):
    return S.grounding_statistics(demo_resolved(spark, sf_dir), order_uids(spark, sf_dir))


THEME_SQL = """CASE WHEN title LIKE 'Service%' THEN 'Service / Execution Activity' WHEN title LIKE 'RDP%' THEN 'Remote Access Activity'
  WHEN title IN ('Admin group change','Password reset') THEN 'Identity / Privilege Activity'
  WHEN title IN ('Firewall rule change','WMI call') THEN 'System / Configuration Activity' ELSE 'Other Investigation Activity' END"""


@query(
    "theme_summary",
    f"""WITH {ORDER_CTE}, t AS (SELECT *, {THEME_SQL} AS theme FROM of),
    u AS (SELECT theme, count(DISTINCT event_uid) AS uid_count FROM t JOIN ou USING (finding_id) GROUP BY 1),
    ft AS (SELECT theme, title, min(seq) AS s FROM t GROUP BY 1, 2)
    SELECT t.theme, count(*) AS finding_count, any_value(u.uid_count) AS uid_count,
      (SELECT string_agg(title, ',' ORDER BY s) FROM ft WHERE ft.theme = t.theme) AS titles FROM t JOIN u ON t.theme = u.theme GROUP BY t.theme""",
)
def theme_summary(spark, sf_dir):
    themes, _ = S.theme_summary(order_findings(spark, sf_dir), order_uids(spark, sf_dir))
    return themes.select(
        "theme", "finding_count", "uid_count", F.array_join("representative_findings", ",").alias("titles")
    )


TIMELINE_CTE = (
    ORDER_CTE
    + f""", placed AS (SELECT * FROM (SELECT of.finding_id, seq, title, ts, line_uid, row_number() OVER (PARTITION BY of.finding_id
      ORDER BY ts, CASE WHEN ln % 2 = 1 THEN 0 ELSE 1 END, line_uid) AS rn FROM of JOIN ou USING (finding_id)) WHERE rn = 1),
    tl AS (SELECT finding_id, title, {THEME_SQL} AS theme, ts, line_uid AS event_uid FROM (
      SELECT *, row_number() OVER (PARTITION BY ts, lower(title) ORDER BY seq, finding_id) AS rk FROM placed) WHERE rk = 1)"""
)


def demo_timeline(spark, sf_dir):
    lines = order_line_uids(spark, sf_dir)
    events = lines.select(
        "event_uid", "event_ts", format_ts(F.col("event_ts")).alias("timestamp"), F.lit("T").alias("timestamp_type"),
        F.lit("S").alias("timestamp_source"), F.lit("HOST").alias("hostname"), F.lit("").alias("windows_event_id"),
        F.lit("").alias("provider"), F.when(F.col("ln") % 2 == 1, "evtxecmd").otherwise("pecmd").alias("source_tool"),
    )
    return S.grounded_timeline(order_findings(spark, sf_dir), lines.select("finding_id", "event_uid"), events)


@query("grounded_timeline", f"WITH {TIMELINE_CTE} SELECT finding_id, title, theme, event_uid, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM tl")
def grounded_timeline(spark, sf_dir):
    return demo_timeline(spark, sf_dir).select("finding_id", "title", "theme", "event_uid", "timestamp")


@query(
    "related_activity",
    f"""WITH {TIMELINE_CTE}, g AS (SELECT *, lag(ts) OVER (ORDER BY ts, finding_id) AS p FROM tl),
    s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) <= 900000000 THEN 0 ELSE 1 END) OVER (ORDER BY ts, finding_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_time, count(*) AS finding_count, count(DISTINCT title) AS title_count
    FROM s GROUP BY sess HAVING count(*) >= 2 AND count(DISTINCT title) >= 2 ORDER BY start_time LIMIT 12""",
)
def related_activity(spark, sf_dir):
    return S.related_activity(cut_lineage(demo_timeline(spark, sf_dir))).select("start_time", "finding_count", "title_count")


STATEMENT_SQL = r"trim(regexp_replace(regexp_replace(lower(trim(text, e' \t\n\r')), '\s+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\\./:$%-]+', ' ', 'g'))"


@query(
    "fact_merge",
    f"""WITH k AS (SELECT doc_id, source, text, {STATEMENT_SQL} AS fact_key FROM documents)
    SELECT md5(fact_key) AS key_hash, min(doc_id) AS first_doc, count(*) AS statements, count(DISTINCT source) AS uid_count FROM k WHERE fact_key <> '' GROUP BY fact_key""",
)
def fact_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", parallel=True)
    facts = docs.select(
        F.col("doc_id").alias("fact_id"), F.col("doc_id").alias("seq"), F.col("text").alias("fact"),
        F.col("doc_id").cast("string").alias("source"),
    )
    uids = docs.select(F.col("doc_id").alias("fact_id"), F.col("source").alias("event_uid"))
    rows, _ = S.merge_facts(facts, uids)
    return rows.select(
        F.md5("fact_key").alias("key_hash"), F.col("source").cast("long").alias("first_doc"), "statements", "uid_count"
    )


@query(
    "distinct_texts",
    """SELECT min(conv_id * 1000 + turn) AS seq, count(*) AS n FROM conversations WHERE trim(text, e' \\t\\n\\r') <> ''
    GROUP BY lower(trim(text, e' \\t\\n\\r'))""",
)
def distinct_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text"
    )
    counts = rows.groupBy(F.lower(clean("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    firsts = S.distinct_texts(rows).withColumn("k", F.lower("text"))
    return firsts.join(counts, "k").select("seq", "n")


@query(
    "text_buckets",
    """WITH t AS (SELECT doc_id AS seq, trim(text, e' \\t\\n\\r') AS text, lower(text) AS low FROM documents),
    b AS (SELECT seq, text, CASE WHEN contains(low, 'service') AND regexp_matches(low, 'origin|purpose|configuration') THEN 'Service origin and configuration context'
      WHEN regexp_matches(low, 'network|file\\s+system|filesystem') THEN 'Network and file-system corroboration'
      WHEN regexp_matches(low, 'user\\s+or\\s+process|process\\s+context|source\\s+of\\s+the\\s+user') THEN 'User and process attribution'
      WHEN regexp_matches(low, 'add\\s+the\\s+user|group\\s+membership|account') THEN 'Account and privilege-change context'
      WHEN regexp_matches(low, 'timestamp|subsequent\\s+actions|follow') THEN 'Timing and follow-on activity'
      WHEN regexp_matches(low, 'additional\\s+logs|artifacts|additional\\s+evidence') THEN 'Additional logs and supporting artifacts' ELSE 'Other evidence gaps' END AS bucket
      FROM t WHERE text <> '')
    SELECT bucket, count(DISTINCT text) AS n FROM b GROUP BY 1""",
)
def text_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    grouped = R.bucket_texts(docs, R.gap_rules(), "Other evidence gaps")
    return grouped.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_bucket_rules",
    """WITH d AS (SELECT doc_id AS seq, trim((['Service origin unclear', 'Service purpose', 'Check the network', 'File  system state', 'Which user or process', 'Process context',
        'Add the user', 'Group membership', 'Timestamp order', 'Follow up', 'Additional  logs', 'Artifacts', 'Service only', 'Nothing here'])[CAST(doc_id % 14 + 1 AS INTEGER)]
        || ' ' || source) AS text FROM documents),
    b AS (SELECT DISTINCT text, CASE WHEN contains(lower(text), 'service') AND regexp_matches(lower(text), 'origin|purpose|configuration') THEN 'Service origin and configuration context'
      WHEN regexp_matches(lower(text), 'network|file\\s+system|filesystem') THEN 'Network and file-system corroboration'
      WHEN regexp_matches(lower(text), 'user\\s+or\\s+process|process\\s+context|source\\s+of\\s+the\\s+user') THEN 'User and process attribution'
      WHEN regexp_matches(lower(text), 'add\\s+the\\s+user|group\\s+membership|account') THEN 'Account and privilege-change context'
      WHEN regexp_matches(lower(text), 'timestamp|subsequent\\s+actions|follow') THEN 'Timing and follow-on activity'
      WHEN regexp_matches(lower(text), 'additional\\s+logs|artifacts|additional\\s+evidence') THEN 'Additional logs and supporting artifacts' ELSE 'Other evidence gaps' END AS bucket FROM d)
    SELECT bucket, count(*) AS n FROM b GROUP BY 1""",
)
def text_bucket_rules(spark, sf_dir):
    """Texts that reach every bucket."""
    starts = [
        "Service origin unclear", "Service purpose", "Check the network", "File  system state", "Which user or process", "Process context",
        "Add the user", "Group membership", "Timestamp order", "Follow up", "Additional  logs", "Artifacts", "Service only", "Nothing here",
    ]
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("doc_id") % len(starts) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat_ws(" ", start, "source").alias("text"))
    grouped = R.bucket_texts(docs, R.gap_rules(), "Other evidence gaps")
    return grouped.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "budget_prefix",
    """SELECT conv_id, turn, running AS running_cost FROM (SELECT conv_id, turn, sum(length(role) + length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE running <= 900 OR rn = 1""",
)
def budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    cost = (F.length("role") + F.length("text")).cast("long")
    return budget_prefix(turns, ["conv_id"], [F.asc("turn")], cost, 900, min_cost=4).select(
        "conv_id", "turn", "running_cost"
    )


@query(
    "keyword_leads",
    """SELECT doc_id, CASE WHEN contains(low, 'drivers\\etc\\hosts') OR contains(low, 'drivers/etc/hosts') THEN 'hosts file modification'
      WHEN contains(low, 'disablerealtimemonitoring') THEN 'Defender real-time monitoring change'
      WHEN contains(low, 'add-mppreference') AND contains(low, 'exclusionpath') THEN 'Defender exclusion change'
      WHEN contains(low, 'noautoupdate') THEN 'Windows Update policy change' END AS lead_kind
    FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' C:\\Windows\\System32\\drivers\\etc\\hosts' WHEN 1 THEN ' Set-MpPreference -DisableRealtimeMonitoring'
      WHEN 2 THEN ' Add-MpPreference -ExclusionPath x' WHEN 3 THEN ' NoAutoUpdate' ELSE '' END) AS low FROM documents) WHERE lead_kind IS NOT NULL""",
)
def keyword_leads(spark, sf_dir):
    from tracewright.functions.labels import command_lead_kind

    docs = table(spark, sf_dir, "documents")
    tails = ["' C:\\\\Windows\\\\System32\\\\drivers\\\\etc\\\\hosts'", "' Set-MpPreference -DisableRealtimeMonitoring'",
             "' Add-MpPreference -ExclusionPath x'", "' NoAutoUpdate'"]
    tail = F.expr("CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(tails)) + " ELSE '' END")
    rows = docs.select("doc_id", command_lead_kind(F.concat("text", tail)).alias("lead_kind"))
    return rows.filter(F.col("lead_kind").isNotNull())


_STAND_SQL = """t AS (SELECT page_id, 'c:\\users\\u' || CAST(page_id % 7 AS VARCHAR) || (['\\downloads\\','\\desktop\\','\\music\\','\\appdata\\'])[CAST(page_id % 4 + 1 AS INTEGER)]
   || 'f' || CAST(page_id % 11 AS VARCHAR) || (['.exe','.ps1','.zip','.txt','.dll'])[CAST(page_id % 5 + 1 AS INTEGER)] AS target, url,
   'CASE-' || CAST(page_id % 2 AS VARCHAR) AS case_id FROM pages)"""


@query(
    "standalone_leads",
    f"""WITH {_STAND_SQL}, q AS (SELECT *, regexp_extract(target, '\\.[a-z0-9]+$') AS ext FROM t),
    k AS (SELECT * FROM q WHERE (ext IN ('.ps1','.zip') OR (ext IN ('.exe','.dll') AND (contains(target, '\\downloads\\') OR contains(target, '\\desktop\\'))))
      AND (contains(target, '\\downloads\\') OR contains(target, '\\desktop\\') OR contains(target, '\\appdata\\')))
    SELECT sha256('1.7|STANDALONE_ARTIFACT_LEAD|' || case_id || '|LNK|' || CASE WHEN ext = '.zip' THEN 'ARCHIVE_OR_PACKAGE' ELSE 'EXECUTABLE_OR_SCRIPT' END || '|' || target) AS finding_id,
      case_id, CASE WHEN ext = '.zip' THEN 'LOW' ELSE 'MEDIUM' END AS confidence, count(*) AS evidence_count FROM k GROUP BY case_id, target, ext""",
)
def standalone_leads(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("\\Downloads\\", "\\Desktop\\", "\\Music\\", "\\AppData\\")]), (F.col("page_id") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".exe", ".ps1", ".zip", ".txt", ".dll")]), (F.col("page_id") % 5 + 1).cast("int"))
    target = F.concat(
        F.lit("C:\\Users\\u"), (F.col("page_id") % 7).cast("string"), folder, F.lit("f"), (F.col("page_id") % 11).cast("string"), ext
    )
    events = pages.select(
        F.col("page_id").cast("string").alias("event_uid"), F.concat(F.lit("CASE-"), (F.col("page_id") % 2).cast("string")).alias("case_id"), F.lit("lecmd").alias("source_tool"),
        F.lit("LNK.TargetCreated").alias("timestamp_source"), F.col("url").alias("timestamp"), target.alias("target_path"),
    )
    return P.standalone_leads(events, RUN)[0].select("finding_id", "case_id", "confidence", "evidence_count")


