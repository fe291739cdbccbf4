"""Registered queries: host telemetry, listings, scalars, retrieval, progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import labels as B
from tracewright.functions import text as X
from tracewright.functions import times as M
from tracewright.plans import acquisition as A
from tracewright.plans import progress as G
from tracewright.plans import quality as Q
from tracewright.plans import report as R
from tracewright.plans import retrieval as V
from tracewright.plans import telemetry as T
from tracewright.registry.base import query
from tracewright.registry.views import staged, table
from tracewright.session import cut_lineage
from tracewright.sources import inventory as I

# Lines stand in for registry and log rows, suppliers for cases.
FACT_KEYS = list(T.FACTS.items())
LINE_KIND = "(l_orderkey * 7 + l_linenumber) % 6"
LINE_CTE = r"""
li AS (SELECT *, 'C' || CAST(l_suppkey AS VARCHAR) AS case_id,
    'L' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS event_uid,
    l_shipdate AS ts, CAST((l_orderkey * 7 + l_linenumber) % 6 AS INTEGER) AS kind, CAST(l_orderkey % 10 AS INTEGER) AS f FROM lineitem),
iface AS (SELECT *, '{G' || CAST(l_partkey % 20 AS VARCHAR) || '}' AS guid,
    (['dhcp_enabled','ipv4_address','default_gateway','dns_servers','dhcp_server','subnet_mask','lease_seconds','lease_obtained','lease_expires','domain'])[f + 1] AS field,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS v FROM li WHERE kind = 0),
fact AS (SELECT *, (['computer_name','operating_system','edition','build_number','build_lab','install_date','registered_owner','system_root','time_zone','active_time_bias_minutes'])[f + 1] AS fact,
    CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'V' || CAST(l_partkey AS VARCHAR) END AS v FROM li WHERE kind = 1),
sam AS (SELECT *, 'user' || CAST(l_partkey % 50 AS VARCHAR) AS username, 1000 + l_partkey % 50 AS rid FROM li WHERE kind = 2),
prof AS (SELECT *, 'S-1-5-21-' || CAST(l_suppkey AS VARCHAR) || '-2-3-' AS stem, 990 + l_partkey % 60 AS rid FROM li WHERE kind = 3),
usb AS (SELECT *, 'S' || CAST(l_partkey % 30 AS VARCHAR) AS serial FROM li WHERE kind = 4),
logon AS (SELECT *, lower('USER' || CAST(l_partkey % 50 AS VARCHAR)) AS name FROM li WHERE kind = 5)
"""


def host_events(spark, sf_dir):
    """Registry and log events made of lines, written once."""

    def build():
        lines = table(spark, sf_dir, "lineitem", parallel=True)
        part = F.col("l_partkey")
        text = lambda c: c.cast("string")
        kind = F.expr(LINE_KIND)
        f = (F.col("l_orderkey") % 10).cast("int")

        def choose(values):
            return F.element_at(F.array(*[F.lit(v) for v in values]), f + 1)

        facts = [spec for _, spec in FACT_KEYS]
        by_kind = lambda *values: F.coalesce(
            *[F.when(kind == i, v) for i, v in enumerate(values) if v is not None], F.lit("")
        )
        return cut_lineage(
            lines.select(
                F.concat(F.lit("C"), text(F.col("l_suppkey"))).alias("case_id"),
                F.concat_ws(
                    "-", F.concat(F.lit("L"), text(F.col("l_orderkey"))), text(F.col("l_linenumber")), text(part), text(F.col("l_suppkey"))
                ).alias("event_uid"),
                M.format_ts(F.col("l_shipdate")).alias("timestamp"),
                F.col("l_shipdate").alias("event_ts"),
                F.when(kind == 5, "evtxecmd").otherwise("recmd").alias("source_tool"),
                F.when(kind == 5, "4624").otherwise("").alias("windows_event_id"),
                by_kind(None, None, None, None, None, F.concat(F.lit("USER"), text(part % 50))).alias("username"),
                by_kind(F.lit("System"), choose([s[0] for s in facts]), F.lit("SAM"), F.lit("SOFTWARE"), F.lit("SYSTEM")).alias("registry_hive"),
                by_kind(
                    F.concat(F.lit("ControlSet001\\Services\\Tcpip\\Parameters\\Interfaces\\{G"), text(part % 20), F.lit("}")),
                    F.concat(F.lit("X\\"), choose([s[1] for s in facts])),
                    F.lit("SAM\\Domains\\Account\\Users\\0001"),
                    F.lit("Microsoft\\Windows NT\\CurrentVersion\\ProfileList\\x"),
                    F.lit("ControlSet001\\Enum\\USBSTOR\\Disk"),
                ).alias("registry_key"),
                by_kind(choose(list(T.INTERFACE_FIELDS)), choose([s[2] for s in facts]), F.lit("V"), F.lit("ProfileImagePath"), F.lit("x")).alias("registry_value_name"),
                by_kind(
                    text(F.col("l_quantity").cast("int")),
                    F.when(part % 9 == 0, "").otherwise(F.concat(F.lit("V"), text(part))),
                    F.concat(F.lit("Username: user"), text(part % 50), F.lit(" Id: "), text(part % 50 + 1000), F.lit(" ValidUserId: True")),
                    F.concat(F.lit("Sid S-1-5-21-"), text(F.col("l_suppkey")), F.lit("-2-3-"), text(part % 60 + 990)),
                    F.concat(
                        F.lit("Manufacturer: Ven_M Title: Prod_P Version: Rev_1 SerialNumber: S"), text(part % 30),
                        F.lit("&0 DeviceName: dev"), text(part), F.lit(" DiskId: {d}"),
                    ),
                ).alias("registry_value_data"),
            )
        )

    return staged(spark, sf_dir, "host_events", build)


@query(
    "first_fact",
    f"""WITH {LINE_CTE} SELECT case_id, fact, arg_min(v, (ts, event_uid)) AS value FROM fact WHERE v <> '' GROUP BY 1, 2""",
)
def first_fact(spark, sf_dir):
    return T.system_facts(host_events(spark, sf_dir)).select("case_id", "fact", "value")


@query(
    "interface_pivot",
    f"""WITH {LINE_CTE}, l AS (SELECT case_id, guid, field, arg_max(v, (ts, event_uid)) AS v FROM iface GROUP BY 1, 2, 3),
    w AS (SELECT case_id, guid AS interface_guid, max(v) FILTER (field = 'dhcp_enabled') = '1' AS dhcp_enabled, max(v) FILTER (field = 'ipv4_address') AS ipv4_address,
      max(v) FILTER (field = 'default_gateway') AS default_gateway, max(v) FILTER (field = 'dns_servers') AS dns_servers, max(v) FILTER (field = 'dhcp_server') AS dhcp_server,
      max(v) FILTER (field = 'subnet_mask') AS subnet_mask, max(v) FILTER (field = 'lease_seconds') AS lease_seconds, max(v) FILTER (field = 'lease_obtained') AS lease_obtained,
      max(v) FILTER (field = 'lease_expires') AS lease_expires, max(v) FILTER (field = 'domain') AS domain FROM l GROUP BY 1, 2)
    SELECT * FROM w WHERE coalesce(ipv4_address, dhcp_server, default_gateway, dns_servers) IS NOT NULL""",
)
def interface_pivot(spark, sf_dir):
    return T.network_interfaces(host_events(spark, sf_dir))


@query(
    "machine_sid",
    f"""WITH {LINE_CTE} SELECT case_id, regexp_replace(arg_min(stem || CAST(rid AS VARCHAR), (ts, event_uid)), '-\\d+$', '') AS machine_sid FROM prof WHERE rid >= 1000 GROUP BY 1""",
)
def machine_sid(spark, sf_dir):
    return T.machine_sid(host_events(spark, sf_dir)).select("case_id", "machine_sid")


@query(
    "account_logons",
    f"""WITH {LINE_CTE}, s AS (SELECT case_id, rid, arg_max(stem || CAST(rid AS VARCHAR), (ts, event_uid)) AS sid FROM prof GROUP BY 1, 2),
    g AS (SELECT case_id, name, count(*) AS n, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), (ts, event_uid)) AS last FROM logon GROUP BY 1, 2)
    SELECT sam.event_uid, sam.username, sam.rid, coalesce(s.sid, 'NOT AVAILABLE') AS sid, coalesce(g.n, 0) AS observed_successful_logons,
      coalesce(g.last, 'NOT AVAILABLE') AS last_observed_successful_logon
    FROM sam LEFT JOIN s ON s.case_id = sam.case_id AND s.rid = sam.rid LEFT JOIN g ON g.case_id = sam.case_id AND g.name = sam.username""",
)
def account_logons(spark, sf_dir):
    return T.accounts(host_events(spark, sf_dir)).select(
        "event_uid", "username", "rid", "sid", "observed_successful_logons", "last_observed_successful_logon"
    )


@query(
    "usb_devices",
    f"""WITH {LINE_CTE} SELECT case_id, serial AS serial_number, 'M' AS manufacturer, 'P' AS product, '1' AS version,
    'dev' || CAST(arg_max(l_partkey, (ts, event_uid)) AS VARCHAR) AS device_name FROM usb GROUP BY 1, 2""",
)
def usb_devices(spark, sf_dir):
    return T.usb_devices(host_events(spark, sf_dir)).select(
        "case_id", "serial_number", "manufacturer", "product", "version", "device_name"
    )


@query(
    "host_card",
    f"""WITH {LINE_CTE}, fx AS (SELECT case_id, fact, arg_min(v, (ts, event_uid)) AS v FROM fact WHERE v <> '' GROUP BY 1, 2),
    w AS (SELECT case_id, max(v) FILTER (fact = 'computer_name') AS computer_name, max(v) FILTER (fact = 'operating_system') AS operating_system,
      max(v) FILTER (fact = 'build_number') AS build_number, max(v) FILTER (fact = 'time_zone') AS time_zone, max(v) FILTER (fact = 'registered_owner') AS registered_owner FROM fx GROUP BY 1),
    ip AS (SELECT case_id, arg_min(v, guid) AS ipv4_address FROM (SELECT case_id, guid, arg_max(v, (ts, event_uid)) AS v FROM iface WHERE field = 'ipv4_address' GROUP BY 1, 2) GROUP BY 1),
    us AS (SELECT case_id, arg_min(username, (rid, event_uid)) AS primary_account FROM sam GROUP BY 1)
    SELECT coalesce(w.case_id, ip.case_id, us.case_id) AS case_id, w.* EXCLUDE (case_id), ip.ipv4_address, us.primary_account
    FROM w FULL JOIN ip ON ip.case_id = w.case_id FULL JOIN us ON us.case_id = coalesce(w.case_id, ip.case_id)""",
)
def host_card(spark, sf_dir):
    events = host_events(spark, sf_dir)
    return T.host_card(T.system_facts(events), T.network_interfaces(events), T.accounts(events))


@query(
    "sam_accounts",
    f"""WITH {LINE_CTE}, u AS (SELECT case_id, rid, arg_min(username, (ts, event_uid)) AS username FROM sam GROUP BY 1, 2),
    s AS (SELECT case_id, rid, arg_max(stem || CAST(rid AS VARCHAR), (ts, event_uid)) AS sid FROM prof GROUP BY 1, 2),
    m AS (SELECT case_id, any_value(rtrim(stem, '-')) AS machine FROM prof GROUP BY 1)
    SELECT u.case_id, u.rid, u.username, coalesce(s.sid, m.machine || '-' || CAST(u.rid AS VARCHAR)) AS sid,
      CASE WHEN s.sid IS NULL AND m.machine IS NOT NULL THEN 'Machine SID + local RID' END AS sid_derivation, u.rid AS rid_from_f, CAST(u.rid % 65536 AS INTEGER) AS logon_count
    FROM u LEFT JOIN s ON s.case_id = u.case_id AND s.rid = u.rid LEFT JOIN m ON m.case_id = u.case_id""",
)
def sam_accounts(spark, sf_dir):
    events = host_events(spark, sf_dir)
    le4 = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    le2 = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c), 4, "0"), 2 * i + 1, 2) for i in (1, 0)])
    rid = F.col("rid")
    blob = F.unhex(F.concat(F.lit("00" * 0x30), le4(rid), F.lit("00" * 4), le4(F.lit(16)), F.lit("00" * 4), le2(F.lit(3)), le2(rid)))
    records = T.account_rows(events).select("case_id", "rid").distinct().withColumn("f_record", blob)
    return T.sam_accounts(events, records).select(
        "case_id", "rid", "username", "sid", "sid_derivation", "rid_from_f", "logon_count"
    )


@query(
    "filetime_decode",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS decoded FROM events""",
)
def filetime_decode(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ticks = (M.micros(F.col("ts")) + M.FILETIME_EPOCH_MICROS) * 10 + F.col("event_id") % 10
    return events.select("event_id", M.format_ts(M.filetime_to_ts(ticks)).alias("decoded"))


# Pages stand in for a listing: 24 path shapes over the page key.
SHAPES = [
    "$MFT", "$Extend/$UsnJrnl:$J", "Windows/System32/winevt/Logs/Sec{k}.evtx", "Windows/System32/config/SYSTEM",
    "Windows/System32/config/SOFTWARE.LOG1", "windows/system32/config/RegBack/SAM", "Users/u{k}/NTUSER.DAT",
    "Users/u{k}/ntuser.dat.LOG2", "Users/u{k}/AppData/Local/Microsoft/Windows/UsrClass.dat", "Windows/Prefetch/APP{k}.EXE-01.pf",
    "Windows/AppCompat/Programs/Amcache.hve", "Windows/System32/sru/SRUDB.dat",
    "Users/u{k}/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history.txt",
    "Users/u{k}/AppData/Roaming/Microsoft/Windows/Recent/d{k}.lnk",
    "Users/u{k}/AppData/Roaming/Microsoft/Windows/Recent/AutomaticDestinations/a{k}.automaticDestinations-ms",
    "Users/u{k}/Desktop/s{k}.lnk", "Users/u{k}/Downloads/x{k}.zip", "Users/u{k}/AppData/Local/Temp/t{k}.tmp",
    "$Recycle.Bin/S-1-5-21/$R{k}.txt", "img/vol/[root]/Windows/Prefetch/B{k}.pf", "vol1/Users/u{k}/Documents/p{k}.doc",
    "Program Files/a{k}.dll", "Windows/notes{k}.txt", "\\Windows\\Prefetch\\C{k}.pf",
]
SHAPE_LIST_SQL = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
LISTING_CTE = f"""lst AS (SELECT page_id, 'v' || CAST(page_id % 3 AS VARCHAR) AS volume, page_id AS row_no, page_id % 13 = 0 AS deleted, CAST(page_id % 24 AS INTEGER) AS shape,
    replace(({SHAPE_LIST_SQL})[CAST(page_id % 24 + 1 AS INTEGER)], '{{k}}', CAST(page_id AS VARCHAR)) AS path FROM pages),
  cls AS (SELECT *, CASE shape WHEN 0 THEN 'filesystem' WHEN 1 THEN 'filesystem' WHEN 2 THEN 'eventlogs' WHEN 3 THEN 'registry' WHEN 4 THEN 'registry' WHEN 5 THEN 'registry'
      WHEN 6 THEN 'registry' WHEN 7 THEN 'registry' WHEN 8 THEN 'registry' WHEN 9 THEN 'prefetch' WHEN 10 THEN 'amcache' WHEN 11 THEN 'srum' WHEN 12 THEN 'powershell_history'
      WHEN 13 THEN 'lnk' WHEN 14 THEN 'jumplists' WHEN 15 THEN 'lnk' WHEN 16 THEN 'user_files' WHEN 17 THEN 'user_files' WHEN 18 THEN 'recycle_bin' WHEN 19 THEN 'prefetch'
      WHEN 20 THEN 'user_files' WHEN 23 THEN 'prefetch' END AS family,
    CASE shape WHEN 0 THEN 'ntfs_mft' WHEN 1 THEN 'ntfs_usn_journal' WHEN 2 THEN 'windows_evtx' WHEN 3 THEN 'registry_machine_system' WHEN 4 THEN 'registry_machine_transaction_log'
      WHEN 5 THEN 'registry_machine_regback' WHEN 6 THEN 'registry_user_ntuser' WHEN 7 THEN 'registry_user_ntuser_transaction_log' WHEN 8 THEN 'registry_user_usrclass'
      WHEN 9 THEN 'windows_prefetch' WHEN 10 THEN 'windows_amcache' WHEN 11 THEN 'windows_srum' WHEN 12 THEN 'powershell_psreadline_history' WHEN 13 THEN 'windows_recent_lnk'
      WHEN 14 THEN 'windows_jumplist' WHEN 15 THEN 'windows_user_lnk' WHEN 16 THEN 'user_downloads' WHEN 17 THEN 'user_temp' WHEN 18 THEN 'windows_recycle_bin'
      WHEN 19 THEN 'windows_prefetch' WHEN 20 THEN 'user_documents' WHEN 23 THEN 'windows_prefetch' END AS rule_id,
    replace(([ '$MFT','$UsnJrnl_$J','Sec{{k}}.evtx','SYSTEM','SOFTWARE.LOG1','RegBack/SAM','users/u{{k}}/NTUSER.DAT','users/u{{k}}/NTUSER.DAT.LOG2','users/u{{k}}/UsrClass.dat',
      'APP{{k}}.EXE-01.pf','Amcache.hve','SRUDB.dat','u{{k}}/ConsoleHost_history.txt','u{{k}}/d{{k}}.lnk','u{{k}}/a{{k}}.automaticDestinations-ms','u{{k}}/Desktop/s{{k}}.lnk',
      'u{{k}}/Downloads/x{{k}}.zip','u{{k}}/Temp/t{{k}}.tmp','S-1-5-21/$R{{k}}.txt','B{{k}}.pf','u{{k}}/Documents/p{{k}}.doc',NULL,NULL,'C{{k}}.pf'])[shape + 1], '{{k}}', CAST(page_id AS VARCHAR)) AS output_name
    FROM lst)"""


def page_listing(spark, sf_dir):
    """The pages table as a filesystem listing."""
    pages = table(spark, sf_dir, "pages")
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("page_id") % 24 + 1).cast("int"))
    return pages.select(
        "page_id", F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string")).alias("volume"),
        F.col("page_id").alias("row_no"), (F.col("page_id") % 13 == 0).alias("deleted"),
        F.replace(shape, F.lit("{k}"), F.col("page_id").cast("string")).alias("path"),
    )


@query("path_classifier", f"WITH {LISTING_CTE} SELECT page_id, family, rule_id, output_name FROM cls")
def path_classifier(spark, sf_dir):
    rows = A.classify_paths(page_listing(spark, sf_dir), "path", "windows_investigation")
    return rows.select("page_id", "family", "rule_id", "output_name")


@query(
    "category_cap",
    f"""WITH {LISTING_CTE} SELECT page_id, family FROM (SELECT *, row_number() OVER (PARTITION BY volume, family ORDER BY row_no) AS rn FROM cls WHERE NOT deleted AND family IS NOT NULL)
    WHERE rn <= CASE family WHEN 'filesystem' THEN 10 WHEN 'eventlogs' THEN 1000 WHEN 'registry' THEN 500 WHEN 'prefetch' THEN 2000 WHEN 'amcache' THEN 10 WHEN 'srum' THEN 10
      WHEN 'lnk' THEN 3000 WHEN 'jumplists' THEN 3000 WHEN 'powershell_history' THEN 100 WHEN 'user_files' THEN 10000 ELSE 5000 END""",
)
def category_cap(spark, sf_dir):
    return A.select_artifacts(page_listing(spark, sf_dir), "windows_investigation").select("page_id", "family")


@query(
    "volume_detection",
    f"""WITH {LISTING_CTE} SELECT volume, count(*) AS entry_count, max(CASE WHEN shape = 3 THEN 1 ELSE 0 END) = 1 OR (max(CASE WHEN shape = 0 THEN 1 ELSE 0 END) = 1 AND
      max(CASE WHEN shape = 2 THEN 1 ELSE 0 END) + max(CASE WHEN shape IN (9, 19, 23) THEN 1 ELSE 0 END) + max(CASE WHEN shape = 10 THEN 1 ELSE 0 END) + max(CASE WHEN shape = 11 THEN 1 ELSE 0 END) >= 2) AS windows_detected
    FROM cls GROUP BY 1""",
)
def volume_detection(spark, sf_dir):
    return A.windows_volumes(page_listing(spark, sf_dir)).select("volume", "entry_count", "windows_detected")


@query(
    "best_volume",
    f"""WITH {LISTING_CTE}, sel AS (SELECT volume, page_id FROM (SELECT *, row_number() OVER (PARTITION BY volume, family ORDER BY row_no) AS rn FROM cls WHERE NOT deleted AND family IS NOT NULL)
    WHERE rn <= CASE family WHEN 'filesystem' THEN 10 WHEN 'eventlogs' THEN 1000 WHEN 'registry' THEN 500 WHEN 'prefetch' THEN 2000 WHEN 'amcache' THEN 10 WHEN 'srum' THEN 10
      WHEN 'lnk' THEN 3000 WHEN 'jumplists' THEN 3000 WHEN 'powershell_history' THEN 100 WHEN 'user_files' THEN 10000 ELSE 5000 END),
    det AS (SELECT volume, count(*) AS entry_count FROM cls GROUP BY 1 HAVING max(CASE WHEN shape = 3 THEN 1 ELSE 0 END) = 1 OR (max(CASE WHEN shape = 0 THEN 1 ELSE 0 END) = 1 AND
      max(CASE WHEN shape = 2 THEN 1 ELSE 0 END) + max(CASE WHEN shape IN (9, 19, 23) THEN 1 ELSE 0 END) + max(CASE WHEN shape = 10 THEN 1 ELSE 0 END) + max(CASE WHEN shape = 11 THEN 1 ELSE 0 END) >= 2))
    SELECT det.volume, count(sel.page_id) AS artifact_count, det.entry_count FROM det LEFT JOIN sel ON sel.volume = det.volume
    GROUP BY det.volume, det.entry_count ORDER BY artifact_count DESC, det.volume LIMIT 1""",
)
def best_volume(spark, sf_dir):
    return A.best_volume(page_listing(spark, sf_dir), "windows_investigation")


@query(
    "family_metrics",
    f"""WITH {LISTING_CTE}, f AS (SELECT lower(path) AS p, length(path) AS n FROM lst)
    SELECT 'Event Logs' AS metric, count(*) FILTER (p LIKE '%.evtx%') AS n FROM f UNION ALL SELECT 'Registry', count(*) FILTER (p LIKE '%ntuser.dat%' OR p LIKE '%usrclass.dat%') FROM f
    UNION ALL SELECT 'Prefetch', count(*) FILTER (p LIKE '%.pf%') FROM f UNION ALL SELECT 'LNK', count(*) FILTER (p LIKE '%.lnk%') FROM f
    UNION ALL SELECT 'Jump Lists', count(*) FILTER (p LIKE '%automaticdestinations-ms%') FROM f
    UNION ALL SELECT 'total_files', count(*) FROM f UNION ALL SELECT 'total_bytes', sum(n) FROM f""",
)
def family_metrics(spark, sf_dir):
    listing = page_listing(spark, sf_dir).select("path", F.length("path").cast("long").alias("length"))
    return I.family_metrics(listing)


@query(
    "recent_files",
    f"""WITH {LISTING_CTE} SELECT path FROM lst ORDER BY page_id DESC, path LIMIT 100""",
)
def recent_files(spark, sf_dir):
    listing = page_listing(spark, sf_dir).select("path", F.lit(1).alias("length"), F.col("page_id").alias("modified"))
    return I.recent_files(listing).select("path")


@query(
    "bounded_listing",
    f"""WITH {LISTING_CTE} SELECT path, (SELECT count(*) FROM lst) AS total, (SELECT count(*) FROM lst) > 40 AS bounded FROM lst ORDER BY path LIMIT 40""",
)
def bounded_listing(spark, sf_dir):
    return I.bounded_listing(page_listing(spark, sf_dir).select("path"), limit=40)


@query(
    "findings_preview",
    """SELECT CAST(doc_id AS VARCHAR) AS finding_id, CASE WHEN doc_id % 4 = 0 THEN 'INFO' ELSE upper(lang) END AS priority,
    CASE WHEN doc_id % 3 = 0 THEN source ELSE trim(left(text, 30), e' \\t\\n\\r') END AS title,
    row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS position
    FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 20""",
)
def findings_preview(spark, sf_dir):
    """The position column holds the order of the preview against the SQL."""
    docs = table(spark, sf_dir, "documents")
    findings = docs.select(
        F.col("doc_id").cast("string").alias("finding_id"), F.when(F.col("doc_id") % 4 != 0, F.upper("lang")).alias("severity"),
        F.when(F.col("doc_id") % 3 != 0, F.left("text", F.lit(30))).otherwise(" ").alias("title"), F.col("source").alias("finding_type"),
    )
    shown = R.findings_preview(findings)
    return shown.withColumn("position", F.row_number().over(Window.orderBy("finding_id")).cast("long"))


@query(
    "status_rollup",
    """SELECT CASE WHEN max(toxic) = 1 THEN 'FAILED' WHEN min(quality) = 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status, count(*) AS tools FROM labels""",
)
def status_rollup(spark, sf_dir):
    status = F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 0, "PARTIAL_SUCCESS").otherwise("SUCCESS")
    return I.overall_status(table(spark, sf_dir, "labels").select(status.alias("status")))


@query(
    "vector_topk",
    """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
      round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
      FROM embeddings q CROSS JOIN embeddings d)
    SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 8""",
)
def vector_topk(spark, sf_dir):
    return demo_hits(spark, sf_dir, V.SEARCH_K)


def demo_hits(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings", parallel=True)
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return V.vector_topk(queries, corpus, k)


HITS_CTE = """s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label,
      round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
      FROM embeddings q CROSS JOIN embeddings d),
   top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 8)"""


# Fixed values, stated apart from the library so that the SQL checks them.
PHASE_LIST = [
    "credential_access", "privilege_escalation", "lateral_movement", "defense_evasion", "discovery", "collection", "persistence",
    "command_and_control", "execution", "initial_access", "impact",
]
BONUS_SQL = """CASE phase WHEN 'credential_access' THEN 0.055::DOUBLE WHEN 'privilege_escalation' THEN 0.05::DOUBLE WHEN 'lateral_movement' THEN 0.05::DOUBLE
  WHEN 'defense_evasion' THEN 0.045::DOUBLE WHEN 'discovery' THEN 0.04::DOUBLE WHEN 'collection' THEN 0.04::DOUBLE WHEN 'persistence' THEN 0.035::DOUBLE
  WHEN 'command_and_control' THEN 0.035::DOUBLE WHEN 'execution' THEN 0.025::DOUBLE WHEN 'initial_access' THEN 0.015::DOUBLE
  WHEN 'impact' THEN -0.08::DOUBLE ELSE 0::DOUBLE END"""
TERMS_SQL = """['network appliance', 'network device', 'controller', 'sd-wan', 'router', 'switch', 'firewall', 'ssh', 'peering', 'configuration',
  'administrative account', 'admin account', 'device configuration', 'control plane']"""


@query(
    "retrieval_chain",
    f"""WITH d AS (SELECT v.vec_id, v.embedding, d.text, ([{', '.join(repr(p) for p in PHASE_LIST)}])[CAST(v.vec_id % 11 + 1 AS INTEGER)] AS phase,
      CASE WHEN v.vec_id % 5 = 0 THEN 'SD-WAN Peering' ELSE 'notes' END AS heading, lang AS place, v.vec_id % 4 AS w FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.text, d.phase, d.heading, d.place, d.w, q.vec_id % 3 AS kind,
      round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
      FROM embeddings q CROSS JOIN d),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 30),
    b AS (SELECT *, round(CASE kind WHEN 0 THEN score + least(len(list_filter({TERMS_SQL}, lambda t: contains(lower(concat_ws(' ', text, phase, heading, place)), t))) * 0.025::DOUBLE, 0.15::DOUBLE)
      WHEN 1 THEN score + {BONUS_SQL} ELSE score END, 6) AS total FROM h),
    p AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS pos FROM b) WHERE pos <= 10),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, place, phase, w ORDER BY pos) AS k FROM p WHERE trim(text, e' \\t\\n\\r') <> '')
      WHERE k = 1 AND length(trim(text, e' \\t\\n\\r')) >= 300)
    SELECT query_id, doc_id, context_rank, total AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS context_rank FROM f) WHERE context_rank <= 6""",
)
def retrieval_chain(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", parallel=True)
    question = F.element_at(
        F.array(F.lit("Which router was used?"), F.lit("What happened before impact?"), F.lit("Who logged on?")), (F.col("vec_id") % 3 + 1).cast("int")
    )
    questions = vectors.select(F.col("vec_id").alias("query_id"), question.alias("question"), F.col("embedding").alias("vector"))
    number = F.col("vec_id")
    chunks = vectors.join(table(spark, sf_dir, "documents"), F.col("doc_id") == number).select(
        "doc_id", F.col("embedding").alias("vector"), "text", F.when(number % 5 == 0, "SD-WAN Peering").otherwise("notes").alias("heading"),
        F.element_at(F.array(*[F.lit(p) for p in PHASE_LIST]), (number % 11 + 1).cast("int")).alias("phase"), F.col("lang").alias("case"),
        (number % 4).alias("window_order"),
    )
    return V.retrieve_context(questions, chunks, pool=30).select("query_id", "doc_id", "context_rank", "score")


@query(
    "best_chunk_per_doc",
    f"""WITH {HITS_CTE}, b AS (SELECT * EXCLUDE (rn) FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) AS rn FROM top) WHERE rn = 1)
    SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 4""",
)
def best_chunk_per_doc(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("report_key")
    )
    hits = demo_hits(spark, sf_dir, V.SEARCH_K).join(labels, "doc_id")
    return V.best_chunk_per_report(hits).select("query_id", "doc_id", "rank")


@query(
    "rerank_bonus",
    f"""WITH d AS (SELECT doc_id, text, doc_id % 3 AS q, ([{', '.join(repr(p) for p in PHASE_LIST)}])[CAST(doc_id % 11 + 1 AS INTEGER)] AS phase,
      text || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'Router and SSH' ELSE 'switch' END AS body,
      CASE WHEN doc_id % 5 = 0 THEN 'SD-WAN Peering' ELSE 'notes' END AS heading, lang || ' firewall' AS place FROM documents),
    m AS (SELECT *, len(list_filter({TERMS_SQL}, lambda t: contains(lower(concat_ws(' ', body, phase, heading, place)), t))) AS hits FROM d)
    SELECT doc_id, round(CASE q WHEN 0 THEN 0.5::DOUBLE + least(hits * 0.025::DOUBLE, 0.15::DOUBLE) WHEN 1 THEN 0.5::DOUBLE + {BONUS_SQL} ELSE 0.5::DOUBLE END, 4) AS score FROM m""",
)
def rerank_bonus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", parallel=True)
    question = F.element_at(
        F.array(F.lit("Which router was used?"), F.lit("What happened before impact?"), F.lit("Who logged on?")),
        (F.col("doc_id") % 3 + 1).cast("int"),
    )
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASE_LIST]), (F.col("doc_id") % 11 + 1).cast("int"))
    body = F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "Router and SSH").otherwise("switch"))
    heading = F.when(F.col("doc_id") % 5 == 0, "SD-WAN Peering").otherwise("notes")
    place = F.concat("lang", F.lit(" firewall"))
    return docs.select("doc_id", F.round(V.rerank_score(question, F.lit(0.5), body, phase, heading, place), 4).alias("score"))


@query(
    "context_selection",
    """WITH r AS (SELECT doc_id, source AS q, lang AS "case", doc_id % 4 AS w, length(trim(text, e' \\t\\n\\r')) AS n FROM documents WHERE trim(text, e' \\t\\n\\r') <> ''),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, "case", w ORDER BY doc_id) AS rn FROM r) WHERE rn = 1 AND n >= 300)
    SELECT q AS query_id, doc_id, context_rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS context_rank FROM f) WHERE context_rank <= 6""",
)
def context_selection(spark, sf_dir):
    ranked = table(spark, sf_dir, "documents", parallel=True).select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("position"), F.col("lang").alias("case"),
        F.lit("p").alias("phase"), (F.col("doc_id") % 4).alias("window_order"), "doc_id", "text", F.lit(0.5).alias("score"),
    )
    return V.select_context(ranked).select("query_id", "doc_id", "context_rank")


@query(
    "grounding_check",
    """WITH a AS (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' psexec and nmap 5. Historical Examples zerologon' WHEN 1 THEN ' nmap'
      WHEN 2 THEN ' fine 5. **Historical Examples** nmap' ELSE ' wmic 5. historical examples' END) AS t, CASE WHEN doc_id % 3 = 0 THEN 'was wmic or nmap used?' ELSE '' END AS q FROM documents),
    p AS (SELECT *, CASE WHEN instr(t, '5. **historical examples**') > 0 THEN instr(t, '5. **historical examples**') ELSE instr(t, '5. historical examples') END AS pos FROM a)
    SELECT doc_id, CASE WHEN pos = 0 THEN 'Historical Examples section not found' ELSE array_to_string(list_filter(
      ['zero.exe','psexec','wmic','cobalt strike','metasploit','zerologon','cve-2020-1472','rustscan','nmap'],
      lambda x: NOT contains(q, x) AND contains(substr(t, 1, pos - 1), x)), ',') END AS violations FROM p""",
)
def grounding_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", parallel=True)
    tails = [" psexec and nmap 5. Historical Examples zerologon", " nmap", " fine 5. **Historical Examples** nmap", " wmic 5. historical examples"]
    answer = F.concat("text", F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("doc_id") % 4 + 1).cast("int")))
    question = F.when(F.col("doc_id") % 3 == 0, "Was WMIC or nmap used?").otherwise("")
    return docs.select("doc_id", F.array_join(V.grounding_violations(answer, question), ",").alias("violations"))


@query(
    "result_grounding",
    """WITH r AS (SELECT conv_id AS finding_id, turn, CASE role WHEN 'user' THEN 'SUSPICIOUS' ELSE 'NEEDS_REVIEW' END AS assessment, turn % 2 = 0 AS escalate FROM conversations),
    x AS (SELECT finding_id, turn, assessment = 'SUSPICIOUS' AND NOT escalate AS esc, finding_id NOT IN (SELECT doc_id FROM labels) AS unk FROM r)
    SELECT finding_id, count(*) AS bad FROM x WHERE esc OR unk GROUP BY 1""",
)
def result_grounding(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    results = turns.select(
        key.alias("finding_id"),
        F.when(F.col("role") == "user", "SUSPICIOUS").otherwise("NEEDS_REVIEW").alias("assessment"),
        F.lit("LOW").alias("priority"), F.lit("LOW").alias("confidence"), (F.col("turn") % 2 == 0).alias("escalate"),
        F.array(F.concat(F.lit("D"), F.col("conv_id").cast("string"))).alias("supporting_event_uids"),
    )
    evidence = turns.select(key.alias("finding_id"), "conv_id").join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi"
    ).select("finding_id", F.concat(F.lit("D"), F.col("conv_id").cast("string")).alias("event_uid"))
    bad = Q.result_problems(results, evidence)
    return bad.groupBy(F.split("finding_id", "-")[0].cast("long").alias("finding_id")).agg(F.count(F.lit(1)).alias("bad"))


@query(
    "phase_progress",
    """WITH l AS (SELECT conv_id, CASE turn % 5 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 10 ELSE NULL END AS idx FROM conversations WHERE role <> '')
    SELECT conv_id AS case_id, max(idx) AS phase_index, round(100.0 * max(idx) / 17, 1) AS percent FROM l GROUP BY 1 HAVING max(idx) IS NOT NULL""",
)
def phase_progress(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    texts = ["NORMALIZATION of inputs", "CORRELATION edges", "PARSING with tools", "INVESTIGATION CONTEXT", "quiet"]
    line = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("turn") % 5 + 1).cast("int"))
    rows = G.case_progress(turns.select(F.col("conv_id").alias("case_id"), line.alias("line")))
    return rows.select("case_id", "phase_index", "percent")


@query(
    "path_scalars",
    r"""SELECT page_id, lower(regexp_replace(replace(url, '/', '\'), '\\+', '\\', 'g')) AS norm_path, regexp_extract(lower(replace(url, '/', '\')), '[^\\]*$') AS base,
    CASE WHEN length(url) > 30 THEN left(url, 30) || '...[truncated]' ELSE url END AS short_url, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS attr_key FROM pages""",
)
def path_scalars(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", X.norm_path("url").alias("norm_path"), X.basename("url").alias("base"),
        X.short("url", 30).alias("short_url"), X.canonical_attribute_key(F.col("url")).alias("attr_key"),
    )


@query(
    "score_bands",
    """SELECT event_id, CASE WHEN value / 500 >= 0.9 THEN 'VERY_HIGH' WHEN value / 500 >= 0.8 THEN 'HIGH' WHEN value / 500 >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band,
    CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' ELSE 'UNKNOWN' END AS severity FROM events""",
)
def score_bands(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spelled = F.element_at(F.array(F.lit(" Informational "), F.lit("CRIT"), F.lit("med"), F.lit("?")), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        "event_id", B.confidence_from_score(F.col("value") / 500).alias("band"), B.normalize_severity(spelled).alias("severity")
    )


@query(
    "timestamp_parsing",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS canonical FROM events""",
)
def timestamp_parsing(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    spelled = (
        F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z")))
        .when(F.col("event_id") % 4 == 1, F.concat(shifted, F.lit("+05:00")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), iso, F.lit("7 ")))
        .otherwise(F.concat(F.lit("on "), iso))
    )
    return events.select("event_id", M.canonical_timestamp_sort(spelled).alias("canonical"))
