"""Registered queries: reads, counts, activity tables and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.times import format_ts, micros
from tracewright.operators.sessions import sessionize
from tracewright.operators.skew import last_by
from tracewright.plans import activity as A
from tracewright.plans import lookups as L
from tracewright.plans import report as R
from tracewright.registry.base import query
from tracewright.registry.views import EV_CTE, events_view, stored_events, table

EV = f"WITH {EV_CTE} "


@query(
    "events_by_time",
    EV + """SELECT event_uid, timestamp, source_tool, event_type FROM ev
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' ORDER BY ts, event_uid LIMIT 1000""",
)
def events_by_time(spark, sf_dir):
    rows = L.events_by_time(events_view(spark, sf_dir), "2024-01-05T00:00:00Z", "2024-01-12 14:00:00+02:00")
    return rows.select("event_uid", "timestamp", "source_tool", "event_type")


@query(
    "events_by_artifact",
    EV + """SELECT event_uid, timestamp, artifact_type, event_type, source_tool, description FROM ev
    WHERE artifact_type = 'prefetch' ORDER BY timestamp, event_uid LIMIT 1000""",
)
def events_by_artifact(spark, sf_dir):
    return L.events_by_artifact(events_view(spark, sf_dir), "prefetch")


@query(
    "windows_events",
    EV + """SELECT event_uid, timestamp, hostname, windows_event_id, provider, channel, username, description FROM ev
    WHERE artifact_type = 'evtx' AND windows_event_id = '4624' AND channel = 'Security' ORDER BY timestamp, event_uid LIMIT 1000""",
)
def windows_events(spark, sf_dir):
    return L.windows_events(events_view(spark, sf_dir), event_id="4624", channel="Security").drop("process_id")


@query(
    "event_lookup",
    EV + """SELECT event_uid, timestamp, k AS attr_k, source_row FROM ev
    ORDER BY ts, event_uid LIMIT 1""",
)
def event_lookup(spark, sf_dir):
    events = events_view(spark, sf_dir)
    uid = events.agg(F.min_by("event_uid", F.struct("event_ts", "event_uid"))).first()[0]
    return L.get_event(events, "DEMO", uid).select(
        "event_uid", "timestamp", F.col("attributes")["k"].cast("long").alias("attr_k"),
        F.col("provenance.source_row").alias("source_row"),
    )


@query("event_uid_hash", EV + "SELECT source_row, event_uid FROM ev")
def event_uid_hash(spark, sf_dir):
    return events_view(spark, sf_dir).select(F.col("provenance.source_row").alias("source_row"), "event_uid")


@query(
    "attribute_explode",
    EV + """SELECT event_uid, 'k' AS attribute_key, CAST(k AS VARCHAR) AS attribute_value FROM ev
    UNION ALL SELECT event_uid, 'record_number', CAST(u AS VARCHAR) FROM ev WHERE source_tool = 'evtxecmd'
    UNION ALL SELECT event_uid, 'executable_info', 'C:\\svc\\app' || CAST(u AS VARCHAR) || '.exe' FROM ev WHERE source_tool = 'evtxecmd'
    UNION ALL SELECT event_uid, 'record_id', CAST(u AS VARCHAR) FROM ev WHERE source_tool = 'hayabusa'
    UNION ALL SELECT event_uid, 'evtx_file', 'Security.evtx' FROM ev WHERE source_tool = 'hayabusa'
    UNION ALL SELECT event_uid, 'prefetch_hash', 'H' || CAST(u AS VARCHAR) FROM ev WHERE source_tool = 'pecmd'
    UNION ALL SELECT event_uid, 'run_count', CAST(k AS VARCHAR) FROM ev WHERE source_tool = 'pecmd'
    UNION ALL SELECT event_uid, 'run_timestamp_field', CASE WHEN k % 3 <> 0 THEN 'LastRun' ELSE 'PreviousRun0' END FROM ev WHERE source_tool = 'pecmd'""",
)
def attribute_explode(spark, sf_dir):
    from tracewright.schema import attribute_rows

    return attribute_rows(events_view(spark, sf_dir))


@query(
    "source_dimension",
    EV + """, d AS (SELECT DISTINCT case_id, source_tool, 'events' AS parser_output,
      CASE WHEN source_tool = 'evtxecmd' THEN 'C:\\logs\\' || channel || '.evtx' ELSE '' END AS source_evidence FROM ev)
    SELECT sha256(concat_ws('|', case_id, source_tool, parser_output, source_evidence)) AS source_id, * FROM d""",
)
def source_dimension(spark, sf_dir):
    from tracewright.schema import source_dimension as dimension

    return dimension(events_view(spark, sf_dir))


@query(
    "unpivot_timestamps",
    """SELECT 'orders' AS src, o_orderkey AS k, 'ORDERED' AS event_type, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM orders
    UNION ALL SELECT 'lineitem', l_orderkey, 'SHIPPED', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') FROM lineitem
    UNION ALL SELECT 'lineitem', l_orderkey, 'RETURNED', strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S.%f') FROM lineitem WHERE l_returnflag = 'R'""",
)
def unpivot_timestamps(spark, sf_dir):
    from tracewright.sources.parsers import unpivot_times

    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("src"), F.col("o_orderkey").alias("k"), format_ts(F.col("o_orderdate")).alias("ordered")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("src"), F.col("l_orderkey").alias("k"),
        format_ts(F.col("l_shipdate")).alias("shipped"),
        F.when(F.col("l_returnflag") == "R", format_ts(F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")))
        .otherwise("").alias("returned"),
    )
    a = unpivot_times(orders, {"ordered": ("ORDERED", "")})
    b = unpivot_times(lines, {"shipped": ("SHIPPED", ""), "returned": ("RETURNED", "")})
    columns = ["src", "k", "event_type", "timestamp"]
    return a.select(*columns).unionByName(b.select(*columns))


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1""",
)
def latest_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    latest = last_by(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return latest.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "event_totals",
    EV + """SELECT count(*) AS total, count(DISTINCT event_uid) AS unique_event_uids,
    min(CASE WHEN timestamp_source NOT LIKE 'LNK.Source%' THEN timestamp END) AS first_timestamp,
    max(CASE WHEN timestamp_source NOT LIKE 'LNK.Source%' THEN timestamp END) AS last_timestamp FROM ev""",
)
def event_totals(spark, sf_dir):
    return R.event_totals(events_view(spark, sf_dir), preserved=False)


@query(
    "group_counts",
    EV + """SELECT 'source_tool' AS metric, source_tool AS label, count(*) AS n FROM ev GROUP BY source_tool
    UNION ALL SELECT 'artifact_type', artifact_type, count(*) FROM ev GROUP BY artifact_type
    UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP BY event_type
    UNION ALL SELECT 'channel', CASE WHEN channel = '' THEN 'UNKNOWN' ELSE channel END, count(*) FROM ev GROUP BY 2""",
)
def group_counts(spark, sf_dir):
    return R.group_counts(
        events_view(spark, sf_dir), ("source_tool", "artifact_type", "event_type", "channel")
    )


@query(
    "zero_filled_counts",
    EV + """SELECT v.event_id, v.label, coalesce(c.n, 0) AS n FROM (VALUES ('4697','Service Installed - Security Log'),('4698','Scheduled Task Created'),
    ('4720','Local User Account Created'),('4728','Member Added to Global Group'),('4732','Member Added to Local Group'),('4740','Account Locked Out'),
    ('7045','Service Installed - System Log')) v(event_id, label) LEFT JOIN
    (SELECT windows_event_id, count(*) AS n FROM ev WHERE source_tool = 'evtxecmd' GROUP BY 1) c ON c.windows_event_id = v.event_id""",
)
def zero_filled_counts(spark, sf_dir):
    return A.label_counts(stored_events(spark, sf_dir), A.PERSISTENCE_LABELS)


AUTH_SQL = (
    EV
    + """, pool AS (SELECT event_uid, timestamp, windows_event_id AS event_id, username,
      CASE WHEN username = '' OR username = '-\\-' THEN 'UNKNOWN' WHEN username LIKE '%$' THEN 'SYSTEM / SERVICE' ELSE 'USER / OTHER' END AS identity_class
      FROM ev WHERE source_tool = 'evtxecmd' AND windows_event_id IN ('4624','4625','4648','4672') ORDER BY ts DESC, event_uid LIMIT 250)
    """
)


@query(
    "auth_ranking",
    AUTH_SQL + """SELECT event_uid, timestamp, event_id, username, identity_class FROM pool ORDER BY
    CASE identity_class WHEN 'USER / OTHER' THEN 0 WHEN 'UNKNOWN' THEN 1 ELSE 2 END, timestamp DESC, event_uid LIMIT 30""",
)
def auth_ranking(spark, sf_dir):
    newest = A.newest_auth(stored_events(spark, sf_dir))
    return A.ranked_auth(newest).select("event_uid", "timestamp", "event_id", "username", "identity_class")


@query("identity_counts", AUTH_SQL + "SELECT identity_class, count(*) AS n FROM pool GROUP BY 1")
def identity_counts(spark, sf_dir):
    return A.identity_counts(A.newest_auth(stored_events(spark, sf_dir)))


@query(
    "eav_pivot",
    EV + """SELECT event_uid, timestamp, executable, 'H' || CAST(u AS VARCHAR) AS prefetch_hash, CAST(k AS VARCHAR) AS run_count
    FROM ev WHERE source_tool = 'pecmd' AND k % 3 <> 0""",
)
def eav_pivot(spark, sf_dir):
    return A.attribute_pivot(events_view(spark, sf_dir)).select(
        "event_uid", "timestamp", "executable", "prefetch_hash", "run_count"
    )


@query(
    "latest_prefetch",
    EV + """SELECT 'H' || CAST(u AS VARCHAR) AS run_key, event_uid, timestamp, k AS runs FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY timestamp DESC, event_uid) AS rn FROM ev WHERE source_tool = 'pecmd' AND k % 3 <> 0)
    WHERE rn = 1 ORDER BY k DESC, timestamp DESC, event_uid LIMIT 40""",
)
def latest_prefetch(spark, sf_dir):
    return A.top_prefetch(stored_events(spark, sf_dir)).select("run_key", "event_uid", "timestamp", "runs")


@query(
    "process_creation",
    EV + """SELECT event_uid, timestamp, username FROM ev WHERE source_tool = 'evtxecmd' AND windows_event_id = '4688'
    ORDER BY ts DESC, event_uid LIMIT 30""",
)
def process_creation(spark, sf_dir):
    return A.process_creation(events_view(spark, sf_dir)).select("event_uid", "timestamp", "username")


@query(
    "shell_items",
    EV + """, pool AS (SELECT * FROM ev WHERE source_tool = 'lecmd' AND timestamp_source NOT LIKE 'LNK.Source%' ORDER BY ts DESC, event_uid LIMIT 100)
    SELECT min(event_uid) AS event_uid, timestamp, target_path AS display_value, timestamp_source FROM pool
    GROUP BY timestamp, target_path, timestamp_source ORDER BY max(ts) DESC, event_uid LIMIT 30""",
)
def shell_items(spark, sf_dir):
    return A.shell_items(stored_events(spark, sf_dir), preserved=False).select(
        "event_uid", "timestamp", "display_value", "timestamp_source"
    )


@query(
    "persistence_events",
    EV + """SELECT event_uid, timestamp, windows_event_id AS event_id,
      CASE windows_event_id WHEN '7045' THEN 'Image: C:\\svc\\app' || CAST(u AS VARCHAR) || '.exe' WHEN '4720' THEN 'Account created: UNKNOWN'
        WHEN '4728' THEN 'Group: UNKNOWN' WHEN '4732' THEN 'Group: UNKNOWN' WHEN '4698' THEN 'Scheduled task created'
        WHEN '4740' THEN 'Account lockout event' ELSE 'Windows security event' END AS observation
    FROM ev WHERE source_tool = 'evtxecmd' AND windows_event_id IN ('4697','4698','4720','4728','4732','4740','7045')
    ORDER BY ts DESC, event_uid LIMIT 50""",
)
def persistence_events(spark, sf_dir):
    return A.persistence_events(stored_events(spark, sf_dir)).select("event_uid", "timestamp", "event_id", "observation")


@query(
    "timeline_examples",
    EV + """SELECT event_uid, timestamp, CASE WHEN path <> '' THEN path WHEN target_path <> '' THEN target_path
      WHEN executable <> '' THEN executable ELSE description END AS display FROM ev
    WHERE timestamp_source NOT LIKE 'LNK.Source%' ORDER BY timestamp, event_uid LIMIT 500""",
)
def timeline_examples(spark, sf_dir):
    return L.timeline_examples(stored_events(spark, sf_dir), preserved=False).select("event_uid", "timestamp", "display")


@query(
    "activity_sessions",
    """SELECT event_type, sess AS session_no, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN us - prev <= 900000000 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS sess FROM (
        SELECT event_type, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM events)) GROUP BY 1, 2""",
)
def activity_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", micros(F.col("ts")).alias("us"))
    return sessionize(rows, ["event_type"], "us", 900_000_000)


SUPPORT_CTE = (
    EV_CTE
    + """, supports AS (SELECT event_uid, 'Detection ' || detection_rule AS title, source_row AS seq FROM ev WHERE source_tool = 'hayabusa' AND k % 10 = 0
    UNION ALL SELECT event_uid, 'Logon burst ' || CAST(u % 7 AS VARCHAR), source_row FROM ev WHERE source_tool = 'evtxecmd' AND k = 5),
  reasons AS (SELECT event_uid, 'Supports finding: ' || title AS reason FROM supports),
  disp AS (SELECT *, CASE
      WHEN source_tool = 'evtxecmd' AND windows_event_id = '7045' THEN 'Image: C:\\svc\\app' || CAST(u AS VARCHAR) || '.exe'
      WHEN source_tool = 'evtxecmd' AND windows_event_id = '4720' THEN 'Account created: UNKNOWN'
      WHEN source_tool = 'evtxecmd' AND windows_event_id IN ('4728','4732') THEN 'Group: UNKNOWN'
      WHEN source_tool = 'evtxecmd' AND windows_event_id = '4698' THEN 'Scheduled task created'
      WHEN source_tool = 'evtxecmd' AND windows_event_id = '4740' THEN 'Account lockout event'
      WHEN source_tool = 'evtxecmd' AND windows_event_id = '4697' THEN 'Windows security event'
      WHEN target_path <> '' THEN target_path WHEN path <> '' THEN path WHEN executable <> '' THEN executable ELSE description END AS display FROM ev),
  rows_ AS (
    SELECT d.*, r.reason, 100 AS prio FROM disp d JOIN reasons r USING (event_uid)
    UNION ALL SELECT *, 'Windows security/activity event ' || windows_event_id, 70 FROM (SELECT * FROM disp WHERE source_tool = 'evtxecmd'
       AND windows_event_id IN ('4625','4648','4672','4697','4698','4720','4728','4732','4740','7045') ORDER BY ts DESC, event_uid LIMIT 250)
       WHERE event_uid NOT IN (SELECT event_uid FROM reasons)
    UNION ALL SELECT *, 'Prefetch execution evidence', 50 FROM (SELECT * FROM disp WHERE source_tool = 'pecmd' ORDER BY ts DESC, event_uid LIMIT 150)
       WHERE event_uid NOT IN (SELECT event_uid FROM reasons)
    UNION ALL SELECT *, 'User file / shell activity', 40 FROM (SELECT * FROM disp WHERE source_tool = 'lecmd' ORDER BY ts DESC, event_uid LIMIT 150)
       WHERE event_uid NOT IN (SELECT event_uid FROM reasons)),
  s0 AS (SELECT * FROM rows_ WHERE NOT (artifact_type = 'hayabusa_detection' AND reason IN (SELECT reason FROM rows_ WHERE prio = 100 AND artifact_type = 'evtx'))),
  s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN prio = 100 THEN reason
      WHEN artifact_type = 'evtx' THEN 'e|' || windows_event_id || '|' || lower(username)
      WHEN artifact_type = 'prefetch' THEN 'p|' || lower(executable) ELSE 'u|' || event_uid END, prio = 100 ORDER BY prio DESC, timestamp, event_uid) AS rn FROM s0)
      WHERE rn <= CASE WHEN prio = 100 THEN 3 ELSE 1 END),
  s2 AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY artifact_type, lower(display), left(timestamp, 19), reason ORDER BY prio DESC, timestamp, event_uid) AS rn FROM s1) WHERE rn = 1),
  s3 AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY artifact_type ORDER BY prio DESC, timestamp, event_uid) AS rn FROM s2)
      WHERE rn <= CASE artifact_type WHEN 'evtx' THEN 18 WHEN 'prefetch' THEN 8 WHEN 'lnk' THEN 7 WHEN 'registry' THEN 5 WHEN 'hayabusa_detection' THEN 2 ELSE 5 END)
"""
)


@query(
    "diversified_topn",
    f"""WITH {SUPPORT_CTE} SELECT event_uid, timestamp, display, reason AS selection_reason, prio AS selection_priority
    FROM s3 ORDER BY prio DESC, timestamp, event_uid LIMIT 40""",
)
def diversified_topn(spark, sf_dir):
    events = stored_events(spark, sf_dir)
    k = F.col("attributes")["k"].cast("long")
    user = F.regexp_extract("username", r"(\d+)$", 1).cast("long")
    supports = (
        events.filter((F.col("source_tool") == "hayabusa") & (k % 10 == 0))
        .select("event_uid", F.concat(F.lit("Detection "), "detection_rule").alias("title"), F.col("provenance.source_row").alias("seq"))
        .unionByName(
            events.filter((F.col("source_tool") == "evtxecmd") & (k == 5)).select(
                "event_uid", F.concat(F.lit("Logon burst "), (user % 7).cast("string")).alias("title"),
                F.col("provenance.source_row").alias("seq"),
            )
        )
    )
    return R.diversified_evidence(events, supports).drop("artifact_type")
