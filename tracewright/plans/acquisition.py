"""Artifact selection from a filesystem listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.skew import top_n
from tracewright.sources.parsers import number_records

# Listing line format and filesystem roots.
LISTING_LINE = r"^\s*(\S+)\s+(?:(\*)\s+)?([^:]+):\s*(.+?)\s*$"
ROOTS = r"windows|users|\$recycle\.bin|\$extend|\$mft|\$logfile"

# Entries per family.
STANDARD_LIMITS = {
    "filesystem": 10, "eventlogs": 1000, "registry": 500, "prefetch": 2000, "amcache": 10, "srum": 10, "lnk": 3000,
    "jumplists": 3000, "powershell_history": 100,
}
INVESTIGATION_LIMITS = {**STANDARD_LIMITS, "user_files": 10000, "recycle_bin": 5000}
PROFILES = {"windows_standard": STANDARD_LIMITS, "windows_investigation": INVESTIGATION_LIMITS}

_CONFIG = "windows/system32/config/"
_HIVES = "(system|software|sam|security|default)"
_LOGS = "(log|log1|log2)"
_USER = "users/([^/]+)/"
_RECENT = "appdata/roaming/microsoft/windows/recent/"
_CLASSES = r"appdata/local/microsoft/windows/usrclass\.dat"

# Rules in order as (rule id, family, type, pattern, output name).
# {n} is group n, {n:U} upper case, {n:l} lower case, {n:s} with reserved
# characters replaced.
STANDARD_RULES = [
    ("ntfs_mft", "filesystem", "mft", r"\$mft", "$MFT"),
    ("ntfs_logfile", "filesystem", "logfile", r"\$logfile", "$LogFile"),
    ("ntfs_usn_journal", "filesystem", "usn_journal", r"(?:\$extend/)?\$usnjrnl:\$j", "$UsnJrnl_$J"),
    ("windows_evtx", "eventlogs", "evtx", r"windows/system32/winevt/logs/(?:.*/)?([^/]*\.evtx)", "{1}"),
    ("registry_machine_{1:l}", "registry", "registry_hive", _CONFIG + _HIVES, "{1:U}"),
    ("registry_machine_transaction_log", "registry", "registry_transaction_log", _CONFIG + _HIVES + r"\." + _LOGS, "{1:U}.{2:U}"),
    ("registry_machine_regback", "registry", "registry_hive_backup", _CONFIG + "regback/" + _HIVES, "RegBack/{1:U}"),
    ("registry_systemprofile_ntuser", "registry", "ntuser", _CONFIG + r"systemprofile/ntuser\.dat", "systemprofile/NTUSER.DAT"),
    ("registry_systemprofile_ntuser_transaction_log", "registry", "registry_transaction_log",
     _CONFIG + r"systemprofile/ntuser\.dat\." + _LOGS, "systemprofile/NTUSER.DAT.{1:U}"),
    ("registry_user_ntuser", "registry", "ntuser", _USER + r"ntuser\.dat", "users/{1:s}/NTUSER.DAT"),
    ("registry_user_ntuser_transaction_log", "registry", "registry_transaction_log",
     _USER + r"ntuser\.dat\." + _LOGS, "users/{1:s}/NTUSER.DAT.{2:U}"),
    ("registry_user_usrclass", "registry", "usrclass", _USER + _CLASSES, "users/{1:s}/UsrClass.dat"),
    ("registry_user_usrclass_transaction_log", "registry", "registry_transaction_log",
     _USER + _CLASSES + r"\." + _LOGS, "users/{1:s}/UsrClass.dat.{2:U}"),
    ("windows_prefetch", "prefetch", "prefetch", r"windows/prefetch/(?:.*/)?([^/]*\.pf)", "{1}"),
    ("windows_amcache", "amcache", "amcache", r"windows/appcompat/programs/amcache\.hve", "Amcache.hve"),
    ("windows_srum", "srum", "srum", r"windows/system32/sru/srudb\.dat", "SRUDB.dat"),
    ("powershell_psreadline_history", "powershell_history", "powershell_history",
     _USER + r"appdata/roaming/microsoft/windows/powershell/psreadline/consolehost_history\.txt", "{1:s}/ConsoleHost_history.txt"),
    ("windows_recent_lnk", "lnk", "lnk",
     _USER + _RECENT + r"(?!(?:.*/)?(?:automatic|custom)destinations/)(?:.*/)?([^/]*\.lnk)", "{1:s}/{2}"),
    ("windows_jumplist", "jumplists", "jumplist",
     _USER + _RECENT + r"(?:.*/)?([^/]*\.(?:automatic|custom)destinations-ms)", "{1:s}/{2}"),
    ("windows_user_lnk", "lnk", "lnk", _USER + r"(.*\.lnk)", "{1:s}/{2:s}"),
]
INVESTIGATION_RULES = STANDARD_RULES + [
    ("user_downloads", "user_files", "user_file", _USER + "downloads/(.+)", "{1:s}/Downloads/{2:s}"),
    ("user_desktop", "user_files", "user_file", _USER + "desktop/(.+)", "{1:s}/Desktop/{2:s}"),
    ("user_documents", "user_files", "user_file", _USER + "documents/(.+)", "{1:s}/Documents/{2:s}"),
    ("user_temp", "user_files", "user_file", _USER + "appdata/local/temp/(.+)", "{1:s}/Temp/{2:s}"),
    ("windows_recycle_bin", "recycle_bin", "recycle_bin_file", r"\$recycle\.bin/([^/]+)/(.+)", "{1:s}/{2:s}"),
]


def read_listing(spark: SparkSession, paths: str | list[str], volume: str | None = None) -> DataFrame:
    """Entries of listing text files; lines of another form are dropped."""
    lines = number_records(spark.read.text(paths), 1)
    group = lambda i: F.regexp_extract("value", LISTING_LINE, i)
    return lines.filter(F.col("value").rlike(LISTING_LINE)).select(
        (F.lit(volume) if volume else F.col("source_file")).alias("volume"),
        F.col("source_row").alias("row_no"),
        group(1).alias("entry_type"),
        (group(2) == "*").alias("deleted"),
        F.trim(group(3)).alias("metadata_address"),
        F.trim(group(4)).alias("path"),
    )


def logical_path(path: Column) -> Column:
    """Path relative to the filesystem root, without container prefixes."""
    bare = F.btrim(F.translate(path, "\\", "/"), F.lit("/"))
    joined = F.regexp_replace(bare, "/+", "/")
    marked = r"(?i)^(?:[^/]+/)*?\[root\](?:/(.*))?$"
    rooted = rf"(?i)^(?:[^/]+/)*?((?:{ROOTS})(?:/.*)?)$"
    return (
        F.when(joined.rlike(marked), F.regexp_extract(joined, marked, 1))
        .when(joined.rlike(rooted), F.regexp_extract(joined, rooted, 1))
        .otherwise(bare)
    )


def user_relative(path: Column) -> tuple[Column, Column]:
    """(user, path below the user folder), blank where the path is elsewhere."""
    pattern = r"(?i)^users/([^/]+)/(.+)$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def safe_component(value: Column) -> Column:
    """Reserved file name characters replaced; slashes stay."""
    return F.regexp_replace(F.regexp_replace(value, r'[<>:"\\|?*]', "_"), "/+", "/")


def _fill(template: str, path: Column, pattern: str) -> Column:
    pieces = []
    for literal, index, mode in re.findall(r"([^{]+)|\{(\d)(?::(\w))?\}", template):
        if literal:
            pieces.append(F.lit(literal))
            continue
        group = F.regexp_extract(path, pattern, int(index))
        pieces.append({"U": F.upper, "l": F.lower, "s": safe_component}.get(mode, lambda c: c)(group))
    return F.concat(*pieces)


def classify_paths(df: DataFrame, path: str, profile: str = "windows_standard") -> DataFrame:
    """Add family, artifact_type, output_name and rule_id; the first matching
    rule decides, rows without a rule get NULLs."""
    if profile not in PROFILES:
        raise ValueError(f"unsupported acquisition profile: {profile}")
    rules = STANDARD_RULES if profile == "windows_standard" else INVESTIGATION_RULES
    located = df.withColumn("logical_path", logical_path(F.col(path)))
    target = F.col("logical_path")
    def chain(cases: list[tuple[Column, Column]]) -> Column:
        (condition, value), *rest = cases
        out = F.when(condition, value)
        for condition, value in rest:
            out = out.when(condition, value)
        return out

    pattern = lambda rule: f"(?is)^{rule[3]}$"
    number = chain([(target.rlike(pattern(rule)), F.lit(i)) for i, rule in enumerate(rules)])
    # A one-element explode keeps later filters on the rule from repeating all
    # pattern tests below it.
    matched = located.select("*", F.explode_outer(F.array(number)).alias("_rule"))

    def by_rule(make) -> Column:
        return chain([(F.col("_rule") == i, make(rule)) for i, rule in enumerate(rules)])

    def labels(position: int) -> Column:
        values = F.array(*[F.lit(rule[position]) for rule in rules])
        return F.when(F.col("_rule").isNotNull(), F.get(values, F.col("_rule")))

    return matched.select(
        *df.columns, "logical_path",
        labels(1).alias("family"), labels(2).alias("artifact_type"),
        by_rule(lambda r: _fill(r[4], target, pattern(r))).alias("output_name"),
        by_rule(lambda r: _fill(r[0], target, pattern(r))).alias("rule_id"),
    )


def select_artifacts(listing: DataFrame, profile: str = "windows_standard") -> DataFrame:
    """Allocated, classified entries, at most the family's limit per volume in
    listing order."""
    limits = PROFILES[profile]
    rows = classify_paths(listing.filter(~F.col("deleted")), "path", profile).filter(F.col("family").isNotNull())
    ranked = top_n(rows, ["volume", "family"], [F.asc("row_no"), F.asc("path")], max(limits.values()), "_rank")
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return ranked.filter(F.col("_rank") <= F.element_at(limit, F.col("family"))).drop("_rank")


def windows_volumes(listing: DataFrame) -> DataFrame:
    """Whether each volume holds a Windows installation, as one roll-up.

    A SYSTEM or SOFTWARE hive decides alone; otherwise filesystem metadata and
    two of five artifact families are needed.
    """
    low = F.lower(F.btrim(F.translate("path", "\\", "/"), F.lit("/")))

    def is_or_ends(*names: str) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | (low == name) | low.endswith("/" + name)
        return hit

    def inside(fragment: str, suffix: str) -> Column:
        return low.contains(fragment) & low.endswith(suffix)

    flags = {
        "strong": is_or_ends(_CONFIG + "system", _CONFIG + "software"),
        "registry": is_or_ends(_CONFIG + "sam", _CONFIG + "security", _CONFIG + "default"),
        "evtx": inside("windows/system32/winevt/logs/", ".evtx"),
        "prefetch": inside("windows/prefetch/", ".pf"),
        "amcache": is_or_ends("windows/appcompat/programs/amcache.hve"),
        "srum": is_or_ends("windows/system32/sru/srudb.dat"),
        "metadata": is_or_ends("$mft", "$logfile"),
    }
    rolled = listing.groupBy("volume").agg(
        *[F.coalesce(F.bool_or(flag), F.lit(False)).alias(name) for name, flag in flags.items()],
        F.count(F.lit(1)).alias("entry_count"),
    )
    families = sum((F.col(c).cast("int") for c in ("registry", "evtx", "prefetch", "amcache", "srum")), F.lit(0))
    return rolled.select(
        "volume", "entry_count", families.alias("family_count"),
        (F.col("strong") | (F.col("metadata") & (families >= 2))).alias("windows_detected"),
    )


def best_volume(listing: DataFrame, profile: str = "windows_standard") -> DataFrame:
    """The Windows volume with most selected artifacts: one row or none."""
    counts = select_artifacts(listing, profile).groupBy("volume").agg(F.count(F.lit(1)).alias("artifact_count"))
    return (
        windows_volumes(listing).filter("windows_detected")
        .join(counts, "volume", "left")
        .withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0)))
        .orderBy(F.desc("artifact_count"), "volume")
        .limit(1)
        .select("volume", "artifact_count", "entry_count")
    )
