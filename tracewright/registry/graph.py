"""Registered queries: event links, components, clusters and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.times import format_ts, micros
from tracewright.operators.interval import crowded_anchors
from tracewright.plans import clusters as C
from tracewright.plans import correlate as K
from tracewright.registry.base import query
from tracewright.registry.views import EV_CTE, events_view, staged, stored_events
from tracewright.session import cut_lineage

RUN = "run-1"
# The tables hold few events per second, so windows are widened to half an hour.
WINDOW = 1800.0
CROWD = None

# Keys, windows, scores and keep-first stated naively in SQL.
KEYS_CTE = (
    EV_CTE
    + r""",
keyed AS (
  SELECT *, lower(replace(path, '/', '\')) AS p1, lower(replace(target_path, '/', '\')) AS p2,
    CASE WHEN source_tool = 'evtxecmd' AND windows_event_id = '7045' THEN ['app' || CAST(u AS VARCHAR) || '.exe'] ELSE [] END AS anchor_extra
  FROM ev),
sets AS (
  SELECT *, list_distinct(list_filter([p1, p2], lambda x: length(x) >= 3)) AS paths,
    list_distinct(list_filter([lower(executable),
      regexp_extract(p1, '[^\\]*$'), regexp_replace(regexp_extract(p1, '[^\\]*$'), '^(.+?\.exe)-[0-9a-f]{8}\.pf$', '\1'),
      regexp_extract(p2, '[^\\]*$')], lambda x: x <> '')) AS execs
  FROM keyed),
anchors AS (
  SELECT *, list_distinct(list_concat(execs, anchor_extra)) AS aexecs FROM sets
  WHERE source_tool IN ('pecmd','recmd','lecmd') OR (source_tool = 'evtxecmd' AND windows_event_id = '7045'))
"""
)
CALM_CTE = (
    KEYS_CTE
    + r""",
windowed AS (
  SELECT a.event_uid, count(c.event_uid) AS n FROM anchors a LEFT JOIN ev c
    ON c.source_tool <> a.source_tool AND c.us BETWEEN a.us - 1800000000 AND a.us + 1800000000
  GROUP BY a.event_uid),
calm AS (SELECT * FROM anchors)
"""
)
EDGES_CTE = (
    CALM_CTE
    + r""",
m1 AS (
  SELECT a.event_uid AS a_uid, c.event_uid AS c_uid, a.source_tool AS a_tool, c.source_tool AS c_tool, a.us AS a_us, c.us AS c_us,
    'HAYABUSA_EVTX_MATCH' AS rel, 1 AS rule,
    least(0.25::DOUBLE + 0.45::DOUBLE
     + CASE WHEN abs(a.us - c.us) <= 1000 THEN 0.15::DOUBLE WHEN abs(a.us - c.us) <= 250000 THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END
     + CASE WHEN a.hostname = c.hostname THEN 0.05::DOUBLE ELSE 0::DOUBLE END
     + CASE WHEN a.channel = c.channel THEN 0.05::DOUBLE ELSE 0::DOUBLE END
     + CASE WHEN c.channel = 'Security' THEN 0.10::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE) AS score
  FROM ev a JOIN ev c ON a.source_tool = 'hayabusa' AND c.source_tool = 'evtxecmd' AND a.u = c.u
    AND a.windows_event_id = c.windows_event_id AND abs(a.us - c.us) <= 1800000000),
m2 AS (
  SELECT a.event_uid, c.event_uid, a.source_tool, c.source_tool, a.us, c.us, 'SHARED_PATH_NEAR_TIME', 2,
    CASE WHEN abs(a.us - c.us) <= 100000 THEN 0.90::DOUBLE ELSE 0.85::DOUBLE END
      + CASE WHEN a.hostname = c.hostname THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  FROM calm a JOIN sets c ON a.source_tool <> c.source_tool AND abs(a.us - c.us) <= 1800000000 AND list_has_any(a.paths, c.paths)),
m3all AS (
  SELECT a.event_uid AS a_uid, c.event_uid AS c_uid, a.source_tool AS a_tool, c.source_tool AS c_tool, a.us AS a_us, c.us AS c_us,
    least(CASE WHEN abs(a.us - c.us) <= 100000 THEN 0.78::DOUBLE ELSE 0.72::DOUBLE END
      + CASE WHEN a.hostname = c.hostname THEN 0.05::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN a.username <> '' AND a.username = c.username THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 0.90::DOUBLE) AS score
  FROM calm a JOIN sets c ON a.source_tool <> c.source_tool AND abs(a.us - c.us) <= 1800000000 AND list_has_any(a.aexecs, c.execs)),
m3 AS (
  SELECT a_uid, c_uid, a_tool, c_tool, a_us, c_us, 'SHARED_EXECUTABLE_NEAR_TIME', 3, score FROM (
    SELECT *, row_number() OVER (PARTITION BY a_uid ORDER BY score DESC, abs(a_us - c_us), c_uid) AS rn FROM m3all) WHERE rn <= 10),
matches AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
edges AS (
  SELECT sha256(concat_ws('|', '1.2', rel, least(a_uid, c_uid), greatest(a_uid, c_uid))) AS edge_uid,
    least(a_uid, c_uid) AS event_uid_a, greatest(a_uid, c_uid) AS event_uid_b,
    CASE WHEN a_uid < c_uid THEN a_tool ELSE c_tool END AS source_tool_a,
    CASE WHEN a_uid < c_uid THEN c_tool ELSE a_tool END AS source_tool_b,
    rel AS relationship_type, round(score, 4) AS score,
    CASE WHEN score >= 0.9 THEN 'VERY_HIGH' WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    abs(a_us - c_us) / 1e6 AS time_delta_seconds
  FROM (SELECT *, row_number() OVER (PARTITION BY least(a_uid, c_uid), greatest(a_uid, c_uid), rel ORDER BY rule, a_us, a_uid) AS rn FROM matches)
  WHERE rn = 1)
"""
)


def demo_events(spark, sf_dir):
    """The events view, written once: the graph plans read it many times."""
    return cut_lineage(events_view(spark, sf_dir, parallel=True))


def staged_graph(spark, sf_dir):
    """(events, edges, clusters, candidates) as written stage tables.

    The stage queries themselves (correlate_edges, connected_components,
    cluster_rollup, candidate_clusters) do not use these.
    """
    events = stored_events(spark, sf_dir)
    edges = staged(spark, sf_dir, "edges", lambda: cut_lineage(demo_edges(spark, sf_dir, events)))

    def write_all(tables):
        return [cut_lineage(t) for t in tables]

    clusters = staged(spark, sf_dir, "clusters", lambda: write_all(C.build_clusters(events, edges, RUN)))
    candidates = staged(spark, sf_dir, "candidates", lambda: write_all(C.build_candidates(events, edges, RUN)))
    return events, edges, clusters, candidates


def demo_edges(spark, sf_dir, events=None):
    """Edges of the events view with the widened windows."""
    events = demo_events(spark, sf_dir) if events is None else events
    return K.correlate(
        events, RUN, detection_window=WINDOW, generic_window=WINDOW, crowd_limit=CROWD
    )


def _flat(edges):
    return edges.select(
        "edge_uid", "event_uid_a", "event_uid_b", "source_tool_a", "source_tool_b",
        "relationship_type", "score", "confidence", "time_delta_seconds",
    )


@query(
    "correlate_edges",
    f"""WITH {EDGES_CTE} SELECT edge_uid, event_uid_a, event_uid_b, source_tool_a, source_tool_b,
    relationship_type, score, confidence, time_delta_seconds FROM edges""",
)
def correlate_edges(spark, sf_dir):
    return _flat(demo_edges(spark, sf_dir))


@query(
    "interval_join_detection",
    f"""WITH {EDGES_CTE} SELECT a_uid, c_uid, round(score, 4) AS score, abs(a_us - c_us) / 1e6 AS delta FROM m1""",
)
def interval_join_detection(spark, sf_dir):
    return K.detection_matches(events_view(spark, sf_dir), window=WINDOW).select(
        "a_uid", "c_uid", F.round("raw_score", 4).alias("score"), "delta"
    )


@query(
    "interval_join_shared_key",
    f"""WITH {EDGES_CTE} SELECT event_uid AS a_uid, event_uid_1 AS c_uid, round(score, 4) AS score, abs(us - us_1) / 1e6 AS delta
    FROM m2 AS t(event_uid, event_uid_1, t1, t2, us, us_1, rel, rule, score)""",
)
def interval_join_shared_key(spark, sf_dir):
    events = demo_events(spark, sf_dir)
    anchors = K.uncrowded_anchors(events, window=WINDOW, limit=CROWD)
    matches = K.shared_key_matches(anchors, events, window=WINDOW)
    return matches.filter(F.col("relationship_type") == K.PATH).select(
        "a_uid", "c_uid", F.round("raw_score", 4).alias("score"), "delta"
    )


@query(
    "top10_per_anchor",
    f"""WITH {EDGES_CTE} SELECT a_uid, c_uid, round(score, 4) AS score, abs(a_us - c_us) / 1e6 AS delta
    FROM m3 AS t(a_uid, c_uid, a_tool, c_tool, a_us, c_us, rel, rule, score)""",
)
def top10_per_anchor(spark, sf_dir):
    events = demo_events(spark, sf_dir)
    anchors = K.uncrowded_anchors(events, window=WINDOW, limit=CROWD)
    matches = K.shared_key_matches(anchors, events, window=WINDOW)
    return matches.filter(F.col("relationship_type") == K.EXECUTABLE).select(
        "a_uid", "c_uid", F.round("raw_score", 4).alias("score"), "delta"
    )


@query("hot_window_skip", f"WITH {CALM_CTE} SELECT event_uid FROM windowed WHERE n > 14")
def hot_window_skip(spark, sf_dir):
    events = demo_events(spark, sf_dir).withColumn("ts_us", micros(F.col("event_ts")))
    anchors = K.generic_anchors(events)
    return crowded_anchors(
        anchors.select("case_id", "event_uid", "source_tool", "ts_us"),
        events.select("case_id", "source_tool", "ts_us"),
        uid="event_uid", group="case_id", source="source_tool", ts_us="ts_us",
        window_us=int(WINDOW * 1_000_000), limit=14,
    )


@query(
    "edge_stats",
    f"""WITH {EDGES_CTE}, deg AS (SELECT u, count(*) AS n FROM (SELECT event_uid_a AS u FROM edges UNION ALL SELECT event_uid_b FROM edges) GROUP BY u)
    SELECT 'confidence' AS metric, confidence AS label, count(*) AS n FROM edges GROUP BY confidence
    UNION ALL SELECT 'relationship', relationship_type, count(*) FROM edges GROUP BY relationship_type
    UNION ALL SELECT 'tool_pair', least(source_tool_a, source_tool_b) || '|' || greatest(source_tool_a, source_tool_b), count(*) FROM edges GROUP BY 2
    UNION ALL SELECT 'max_degree', '', coalesce(max(n), 0) FROM deg""",
)
def edge_stats(spark, sf_dir):
    return C.edge_statistics(staged_graph(spark, sf_dir)[1])


@query(
    "edge_counts",
    f"""WITH {EDGES_CTE} SELECT relationship_type, confidence, count(*) AS n, round(avg(score), 4) AS mean_score FROM edges GROUP BY 1, 2""",
)
def edge_counts(spark, sf_dir):
    return C.edge_counts(staged_graph(spark, sf_dir)[1]).withColumn("mean_score", F.round("mean_score", 4))


@query("skipped_anchors", f"WITH {CALM_CTE} SELECT event_uid, source_tool FROM windowed JOIN anchors USING (event_uid) WHERE n > 20")
def skipped_anchors(spark, sf_dir):
    return K.skipped_anchors(demo_events(spark, sf_dir), window=WINDOW, limit=20).select("event_uid", "source_tool")


@query(
    "top_edges",
    f"""WITH {EDGES_CTE} SELECT edge_uid, score, time_delta_seconds FROM edges
    ORDER BY score DESC, time_delta_seconds, edge_uid LIMIT 20""",
)
def top_edges(spark, sf_dir):
    return (
        staged_graph(spark, sf_dir)[1]
        .orderBy(F.desc("score"), "time_delta_seconds", "edge_uid")
        .limit(20)
        .select("edge_uid", "score", "time_delta_seconds")
    )


LABELS_CTE = (
    EDGES_CTE
    + r""",
strong AS (SELECT * FROM edges WHERE confidence IN ('VERY_HIGH','HIGH')),
weak AS (SELECT * FROM edges WHERE confidence = 'MEDIUM'),
links AS (SELECT event_uid_a AS a, event_uid_b AS b FROM strong UNION SELECT event_uid_b, event_uid_a FROM strong),
reach(node, seen) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
labels AS (SELECT node AS event_uid, min(seen) AS core FROM reach GROUP BY node)
"""
)


@query("connected_components", f"WITH RECURSIVE {LABELS_CTE} SELECT event_uid, core FROM labels")
def components(spark, sf_dir):
    return C.core_labels(demo_edges(spark, sf_dir))


@query(
    "medium_attach",
    f"""WITH RECURSIVE {LABELS_CTE} SELECT w.edge_uid,
    CASE WHEN a.core IS NOT NULL AND b.core IS NOT NULL THEN CASE WHEN a.core = b.core THEN 'SAME_CORE' ELSE 'CROSS_CORE' END
         WHEN a.core IS NOT NULL OR b.core IS NOT NULL THEN 'ATTACHED' ELSE 'UNCLUSTERED' END AS placement,
    CASE WHEN a.core IS NOT NULL AND b.core IS NULL THEN w.event_uid_b WHEN a.core IS NULL AND b.core IS NOT NULL THEN w.event_uid_a END AS attached_uid
    FROM weak w LEFT JOIN labels a ON w.event_uid_a = a.event_uid LEFT JOIN labels b ON w.event_uid_b = b.event_uid""",
)
def medium_attach(spark, sf_dir):
    edges = staged_graph(spark, sf_dir)[1]
    return C.attach_weak_edges(edges, C.core_labels(edges)).select(
        "edge_uid", "placement", "attached_uid"
    )


CLUSTERS_CTE = (
    LABELS_CTE
    + r""",
placed AS (
  SELECT w.*, a.core AS ca, b.core AS cb FROM weak w LEFT JOIN labels a ON w.event_uid_a = a.event_uid LEFT JOIN labels b ON w.event_uid_b = b.event_uid),
cl_edges AS (
  SELECT l.core, s.edge_uid, s.relationship_type, s.confidence FROM strong s JOIN labels l ON s.event_uid_a = l.event_uid
  UNION ALL SELECT coalesce(ca, cb), edge_uid, relationship_type, confidence FROM placed WHERE (ca = cb) OR (ca IS NULL) <> (cb IS NULL)),
members AS (
  SELECT core, event_uid, 'CORE' AS membership_role FROM labels
  UNION ALL SELECT DISTINCT coalesce(ca, cb), CASE WHEN ca IS NULL THEN event_uid_a ELSE event_uid_b END, 'MEDIUM_ATTACHMENT'
  FROM placed WHERE (ca IS NULL) <> (cb IS NULL)),
ids AS (
  SELECT core, sha256(concat_ws('|', 'run-1', '1.1', min(event_uid), CAST(count(*) AS VARCHAR),
    CAST(sum(CAST('0x' || substr(event_uid, 1, 15) AS BIGINT)) AS VARCHAR))) AS cluster_id FROM labels GROUP BY core),
cl_events AS (
  SELECT i.cluster_id, m.event_uid, e.source_tool, e.family AS evidence_family, m.membership_role, e.timestamp, m.core,
    e.detection_rule, e.description, e.severity, e.executable, e.path, e.target_path
  FROM members m JOIN ids i USING (core) JOIN ev e USING (event_uid)),
by_edge AS (
  SELECT core, count(*) AS edge_count, max(confidence = 'MEDIUM') AS weak, array_to_string(list_sort(list(DISTINCT relationship_type)), ',') AS relationship_types
  FROM cl_edges GROUP BY core),
clusters AS (
  SELECT cluster_id, any_value(CASE WHEN b.weak THEN 'HIGH' ELSE 'VERY_HIGH' END) AS cluster_confidence,
    min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS event_count, any_value(b.edge_count) AS edge_count,
    count(DISTINCT evidence_family) AS independent_family_count,
    array_to_string(list_sort(list(DISTINCT source_tool)), ',') AS source_tools,
    array_to_string(list_sort(list(DISTINCT evidence_family)), ',') AS evidence_families,
    any_value(b.relationship_types) AS relationship_types, max(source_tool = 'hayabusa') AS has_detection
  FROM cl_events JOIN by_edge b USING (core) GROUP BY cluster_id)
"""
)


def _join_lists(df, *names):
    for name in names:
        df = df.withColumn(name, F.array_join(name, ","))
    return df


def _with_text_times(df):
    return df.withColumn("start_timestamp", format_ts(F.col("start_ts"))).withColumn(
        "end_timestamp", format_ts(F.col("end_ts"))
    )


def demo_clusters(spark, sf_dir):
    """(events, edges, clusters, cluster_events, cluster_edges)."""
    events = demo_events(spark, sf_dir)
    edges = cut_lineage(demo_edges(spark, sf_dir, events))
    return (events, edges, *C.build_clusters(events, edges, RUN))


CLUSTER_COLUMNS = [
    "cluster_id", "cluster_confidence", "start_timestamp", "end_timestamp", "event_count", "edge_count",
    "independent_family_count", "source_tools", "evidence_families", "relationship_types", "has_detection",
]


@query("cluster_rollup", f"WITH RECURSIVE {CLUSTERS_CTE} SELECT {', '.join(CLUSTER_COLUMNS)} FROM clusters")
def cluster_rollup(spark, sf_dir):
    _, _, clusters, _, _ = demo_clusters(spark, sf_dir)
    rows = _join_lists(_with_text_times(clusters), "source_tools", "evidence_families", "relationship_types")
    return rows.select(*CLUSTER_COLUMNS)


@query(
    "cluster_members",
    f"""WITH RECURSIVE {CLUSTERS_CTE} SELECT cluster_id, event_uid, source_tool, evidence_family, membership_role FROM cl_events""",
)
def cluster_members(spark, sf_dir):
    return staged_graph(spark, sf_dir)[2][1]


@query(
    "top_clusters",
    f"""WITH RECURSIVE {CLUSTERS_CTE} SELECT cluster_id, independent_family_count, event_count, edge_count FROM clusters
    ORDER BY independent_family_count DESC, event_count DESC, edge_count DESC, cluster_id LIMIT 20""",
)
def top_clusters(spark, sf_dir):
    clusters = staged_graph(spark, sf_dir)[2][0]
    return (
        clusters.orderBy(
            F.desc("independent_family_count"), F.desc("event_count"), F.desc("edge_count"), "cluster_id"
        )
        .limit(20)
        .select("cluster_id", "independent_family_count", "event_count", "edge_count")
    )


@query(
    "family_histogram",
    f"""WITH RECURSIVE {CLUSTERS_CTE} SELECT independent_family_count, count(*) AS n FROM clusters GROUP BY 1""",
)
def family_histogram(spark, sf_dir):
    clusters = staged_graph(spark, sf_dir)[2][0]
    return clusters.groupBy("independent_family_count").agg(F.count(F.lit(1)).alias("n"))


CANDIDATES_CTE = (
    CLUSTERS_CTE
    + r""",
fam(tool, f) AS (VALUES ('evtxecmd','EVTX'),('hayabusa','EVTX'),('mftecmd','MFT'),('pecmd','PREFETCH'),('lecmd','LNK')),
indep AS (
  SELECT w.* FROM weak w JOIN fam a ON a.tool = w.source_tool_a JOIN fam b ON b.tool = w.source_tool_b
  WHERE a.f <> b.f AND relationship_type IN ('SHARED_EXECUTABLE_NEAR_TIME','SHARED_PATH_NEAR_TIME')),
clinks AS (SELECT event_uid_a AS a, event_uid_b AS b FROM indep UNION SELECT event_uid_b, event_uid_a FROM indep),
creach(node, seen) AS (SELECT a, a FROM clinks UNION SELECT r.node, l.b FROM creach r JOIN clinks l ON r.seen = l.a),
clabels AS (SELECT node AS event_uid, min(seen) AS core FROM creach GROUP BY node),
cids AS (
  SELECT core, sha256(concat_ws('|', 'run-1', '1.1', min(event_uid), CAST(count(*) AS VARCHAR),
    CAST(sum(CAST('0x' || substr(event_uid, 1, 15) AS BIGINT)) AS VARCHAR))) AS candidate_id FROM clabels GROUP BY core),
cand_events AS (
  SELECT i.candidate_id, l.core, e.* FROM clabels l JOIN cids i USING (core) JOIN ev e USING (event_uid)
  WHERE core IN (SELECT core FROM clabels JOIN ev USING (event_uid) GROUP BY core HAVING count(DISTINCT family) >= 2)),
cand_edges AS (SELECT i.candidate_id, w.* FROM indep w JOIN clabels l ON w.event_uid_a = l.event_uid JOIN cids i USING (core)
  WHERE i.candidate_id IN (SELECT candidate_id FROM cand_events)),
candidates AS (
  SELECT candidate_id, count(*) AS event_count, count(DISTINCT family) AS independent_family_count,
    min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp,
    array_to_string(list_sort(list(DISTINCT source_tool)), ',') AS source_tools,
    array_to_string(list_sort(list(DISTINCT family)), ',') AS evidence_families,
    any_value(x.edge_count) AS edge_count, any_value(x.relationship_types) AS relationship_types
  FROM cand_events JOIN (SELECT candidate_id, count(*) AS edge_count, array_to_string(list_sort(list(DISTINCT relationship_type)), ',') AS relationship_types
    FROM cand_edges GROUP BY candidate_id) x USING (candidate_id) GROUP BY candidate_id)
"""
)
CANDIDATE_COLUMNS = [
    "candidate_id", "event_count", "edge_count", "independent_family_count", "start_timestamp", "end_timestamp",
    "source_tools", "evidence_families", "relationship_types",
]


@query("candidate_clusters", f"WITH RECURSIVE {CANDIDATES_CTE} SELECT {', '.join(CANDIDATE_COLUMNS)} FROM candidates")
def candidate_clusters(spark, sf_dir):
    events = demo_events(spark, sf_dir)
    edges = cut_lineage(demo_edges(spark, sf_dir, events))
    candidates, *_ = C.build_candidates(events, edges, RUN)
    rows = _join_lists(_with_text_times(candidates), "source_tools", "evidence_families", "relationship_types")
    return rows.select(*CANDIDATE_COLUMNS)


@query(
    "top_candidates",
    f"""WITH RECURSIVE {CANDIDATES_CTE} SELECT candidate_id, edge_count, event_count, start_timestamp FROM candidates
    ORDER BY edge_count DESC, event_count DESC, start_timestamp, candidate_id LIMIT 15""",
)
def top_candidates(spark, sf_dir):
    candidates = staged_graph(spark, sf_dir)[3][0]
    return (
        _with_text_times(candidates)
        .orderBy(F.desc("edge_count"), F.desc("event_count"), "start_timestamp", "candidate_id")
        .limit(15)
        .select("candidate_id", "edge_count", "event_count", "start_timestamp")
    )

