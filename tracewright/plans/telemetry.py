"""Host and account facts from registry and log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import nonblank
from tracewright.functions.times import FILETIME_END, filetime_to_ts

# Fact -> (hive, key part, value name).
_VERSION_KEY = "microsoft\\windows nt\\currentversion"
_ZONE_KEY = "control\\timezoneinformation"
FACTS = {
    "computer_name": ("system", "control\\computername\\computername", "computername"),
    "operating_system": ("software", _VERSION_KEY, "productname"),
    "edition": ("software", _VERSION_KEY, "editionid"),
    "build_number": ("software", _VERSION_KEY, "currentbuildnumber"),
    "build_lab": ("software", _VERSION_KEY, "buildlabex"),
    "install_date": ("software", _VERSION_KEY, "installdate"),
    "registered_owner": ("software", _VERSION_KEY, "registeredowner"),
    "system_root": ("software", _VERSION_KEY, "systemroot"),
    "time_zone": ("system", _ZONE_KEY, "timezonekeyname"),
    "active_time_bias_minutes": ("system", _ZONE_KEY, "activetimebias"),
}
# Interface value name -> field, and the fields that make an
# interface worth keeping.
INTERFACE_FIELDS = {
    "enabledhcp": "dhcp_enabled", "dhcpipaddress": "ipv4_address", "dhcpdefaultgateway": "default_gateway",
    "dhcpnameserver": "dns_servers", "dhcpserver": "dhcp_server", "dhcpsubnetmask": "subnet_mask",
    "lease": "lease_seconds", "leaseobtainedtime": "lease_obtained", "leaseterminatestime": "lease_expires",
    "domain": "domain",
}
INTERFACE_KEEP = ["ipv4_address", "dhcp_server", "default_gateway", "dns_servers"]
INTERFACE_KEY = "\\services\\tcpip\\parameters\\interfaces\\"

# Patterns.
USER_TEXT = r"(?i)Username:\s*(.*?)\s+Id:\s*(\d+)\s+ValidUserId:\s*(True|False)"
SID_TEXT = r"(?i)(S-1-5-21-(?:\d+-){2}\d+-(\d+))"
USB_TEXT = (
    r"(?i)Manufacturer:\s*(.*?)\s+Title:\s*(.*?)\s+Version:\s*(.*?)\s+SerialNumber:\s*(.*?)\s+"
    r"DeviceName:\s*(.*?)\s+DiskId:\s*(\{[^}]+\})"
)
GUID_TEXT = r"(?i)Interfaces\\(\{[^}]+\})"
NOT_AVAILABLE = "NOT AVAILABLE"
BUILT_IN_RIDS = [500, 501]


def registry_rows(events: DataFrame) -> DataFrame:
    """Registry columns of the registry parser's events."""
    return events.filter(F.lower("source_tool") == "recmd").select(
        "case_id", "event_uid", "timestamp", "event_ts", "registry_hive", "registry_key", "registry_value_name",
        "registry_value_data",
    )


def _hive() -> Column:
    return F.lower(F.coalesce("registry_hive", F.lit("")))


def _key() -> Column:
    return F.lower(F.coalesce("registry_key", F.lit("")))


def _order() -> Column:
    """Row order the reads are defined by: time, then uid."""
    return F.struct("event_ts", "event_uid")


def system_facts(events: DataFrame) -> DataFrame:
    """First matching registry value per fact and case, in one pass.

    A row is tested against the constant fact list, then a mergeable minimum
    picks the first.
    """
    name = F.lower(F.coalesce("registry_value_name", F.lit("")))
    value = nonblank("registry_value_data")
    matches = F.array_compact(
        F.array(
            *[
                F.when((_hive() == hive) & _key().contains(part) & (name == wanted), F.lit(fact))
                for fact, (hive, part, wanted) in FACTS.items()
            ]
        )
    )
    rows = registry_rows(events).filter(name.isin([f[2] for f in FACTS.values()])).select(
        "case_id", F.explode(matches).alias("fact"), value.alias("value"), "event_uid", "event_ts", "registry_hive"
    )
    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy("case_id", "fact")
        .agg(F.min_by(F.struct("value", "event_uid", "registry_hive"), _order()).alias("f"))
        .select("case_id", "fact", "f.value", "f.event_uid", F.concat(F.lit("Registry/"), "f.registry_hive").alias("source"))
    )


def _profile_sids(events: DataFrame) -> DataFrame:
    data = F.coalesce("registry_value_data", F.lit(""))
    return (
        registry_rows(events)
        .filter(_key().contains("profilelist") & data.rlike(SID_TEXT))
        .select(
            "case_id", "event_uid", "event_ts",
            F.regexp_extract(data, SID_TEXT, 1).alias("sid"),
            F.regexp_extract(data, SID_TEXT, 2).cast("long").alias("rid"),
        )
    )


def _machine_part(sid: Column) -> Column:
    return F.regexp_replace(sid, r"-\d+$", "")


def machine_sid(events: DataFrame) -> DataFrame:
    """First local account SID of a case without its RID."""
    rows = _profile_sids(events).filter(F.col("rid") >= 1000)
    first = rows.groupBy("case_id").agg(F.min_by(F.struct("sid", "event_uid"), _order()).alias("f"))
    return first.select(
        "case_id", _machine_part(F.col("f.sid")).alias("machine_sid"), F.col("f.sid").alias("derived_from"), "f.event_uid"
    )


def account_rows(events: DataFrame) -> DataFrame:
    """Account rows of the SAM hive."""
    data = F.coalesce("registry_value_data", F.lit(""))
    return (
        registry_rows(events)
        .filter((_hive() == "sam") & _key().contains("sam\\domains\\account\\users") & data.rlike(USER_TEXT))
        .select(
            "case_id", "event_uid", "event_ts", "registry_value_name",
            F.trim(F.regexp_extract(data, USER_TEXT, 1)).alias("username"),
            F.regexp_extract(data, USER_TEXT, 2).cast("long").alias("rid"),
            (F.lower(F.regexp_extract(data, USER_TEXT, 3)) == "true").alias("valid_user_id"),
        )
    )


def accounts(events: DataFrame) -> DataFrame:
    """Accounts with profile SID and observed logons.

    The last profile row of a RID wins. Logons are counted per lower-case name
    before they meet the accounts.
    """
    sids = _profile_sids(events).groupBy("case_id", "rid").agg(
        F.max_by(F.struct("sid", F.col("event_uid").alias("sid_event_uid")), _order()).alias("s")
    )
    logons = (
        events.filter(F.col("windows_event_id") == "4624")
        .groupBy("case_id", F.lower(F.coalesce("username", F.lit(""))).alias("_name"))
        .agg(
            F.count(F.lit(1)).alias("logons"),
            F.max_by(F.struct("timestamp", "event_uid"), F.struct("event_ts", "event_uid")).alias("l"),
        )
    )
    return (
        account_rows(events)
        .withColumn("_name", F.lower("username"))
        .join(sids, ["case_id", "rid"], "left")
        .join(logons, ["case_id", "_name"], "left")
        .select(
            "case_id", "event_uid", "username", "rid", "valid_user_id",
            F.coalesce("s.sid", F.lit(NOT_AVAILABLE)).alias("sid"), "s.sid_event_uid",
            F.coalesce("logons", F.lit(0)).alias("observed_successful_logons"),
            F.coalesce("l.timestamp", F.lit(NOT_AVAILABLE)).alias("last_observed_successful_logon"),
            F.col("l.event_uid").alias("last_logon_event_uid"),
        )
    )


def network_interfaces(events: DataFrame) -> DataFrame:
    """One row per interface with its fields; the last value of a field wins.

    Values reduce to one row per (interface, field) before the pivot.
    """
    key = F.coalesce("registry_key", F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in INTERFACE_FIELDS.items() for x in pair])
    field = F.try_element_at(names, F.lower(F.coalesce("registry_value_name", F.lit(""))))
    rows = (
        registry_rows(events)
        .filter((_hive() == "system") & F.lower(key).contains(INTERFACE_KEY))
        .select(
            "case_id", F.regexp_extract(key, GUID_TEXT, 1).alias("interface_guid"), field.alias("field"),
            nonblank("registry_value_data").alias("value"), "event_uid", "event_ts",
        )
        .filter((F.col("interface_guid") != "") & F.col("field").isNotNull() & F.col("value").isNotNull())
    )
    last = rows.groupBy("case_id", "interface_guid", "field").agg(F.max_by("value", _order()).alias("value"))
    wide = last.groupBy("case_id", "interface_guid").pivot("field", list(INTERFACE_FIELDS.values())).agg(F.max("value"))
    keep = F.coalesce(*[F.col(c) for c in INTERFACE_KEEP]).isNotNull()
    return wide.filter(keep).withColumn("dhcp_enabled", F.col("dhcp_enabled") == "1")


def usb_devices(events: DataFrame) -> DataFrame:
    """Devices by serial number, the last row wins."""
    data = F.coalesce("registry_value_data", F.lit(""))
    part = lambda i: F.regexp_extract(data, USB_TEXT, i)
    rows = (
        registry_rows(events)
        .filter((_hive() == "system") & _key().contains("\\enum\\usbstor") & data.rlike(USB_TEXT))
        .select(
            "case_id", "event_uid", "event_ts", "timestamp",
            F.regexp_replace(F.trim(part(4)), "&0$", "").alias("serial_number"),
            F.trim(F.replace(part(1), F.lit("Ven_"), F.lit(""))).alias("manufacturer"),
            F.trim(F.replace(part(2), F.lit("Prod_"), F.lit(""))).alias("product"),
            F.trim(F.replace(part(3), F.lit("Rev_"), F.lit(""))).alias("version"),
            F.trim(part(5)).alias("device_name"), part(6).alias("disk_id"),
        )
    )
    return (
        rows.groupBy("case_id", "serial_number")
        .agg(
            F.max_by(
                F.struct(
                    "manufacturer", "product", "version", "device_name", "disk_id", "event_uid",
                    F.col("timestamp").alias("registry_last_write"),
                ),
                _order(),
            ).alias("d")
        )
        .select("case_id", "serial_number", "d.*")
    )


def host_card(facts: DataFrame, interfaces: DataFrame, users: DataFrame) -> DataFrame:
    """One row per case: name, system, zone, first address, first real account."""
    wanted = ["computer_name", "operating_system", "build_number", "time_zone", "registered_owner"]
    wide = facts.groupBy("case_id").pivot("fact", wanted).agg(F.max("value"))
    address = interfaces.filter(F.col("ipv4_address").isNotNull()).groupBy("case_id").agg(
        F.min_by("ipv4_address", "interface_guid").alias("ipv4_address")
    )
    person = users.filter(~F.col("rid").isin(BUILT_IN_RIDS)).groupBy("case_id").agg(
        F.min_by("username", F.struct("rid", "event_uid")).alias("primary_account")
    )
    return wide.join(address, "case_id", "full").join(person, "case_id", "full")


def _le(raw: Column, offset: int, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset of a binary column."""
    digits = F.hex(F.substring(raw, offset + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def decode_account_record(raw: Column) -> Column:
    """Fields of a binary account record; NULL where it is too short."""
    when_present = F.octet_length(raw) >= 0x44

    def moment(offset: int) -> Column:
        # Values past the signed range are past the year 9999 too, hence NULL.
        ticks = _le(raw, offset, 8)
        return filetime_to_ts(F.when(ticks <= F.lit(FILETIME_END), ticks).cast("long"))

    return F.when(
        when_present,
        F.struct(
            moment(0x08).alias("last_logon"), moment(0x18).alias("password_last_set"),
            moment(0x20).alias("account_expires"), moment(0x28).alias("last_failed_logon"),
            _le(raw, 0x30, 4).cast("long").alias("rid_from_f"), _le(raw, 0x38, 4).cast("long").alias("account_control_raw"),
            _le(raw, 0x40, 2).cast("int").alias("failed_logon_count"), _le(raw, 0x42, 2).cast("int").alias("logon_count"),
        ),
    )


def sam_accounts(events: DataFrame, records: DataFrame) -> DataFrame:
    """Account table from SAM rows and binary records (case_id, rid, f_record).

    The first row of a RID wins; a RID without a profile SID takes the machine
    SID of the case.
    """
    users = account_rows(events).filter(F.col("registry_value_name") == "V").groupBy("case_id", "rid").agg(
        F.min_by(F.struct("username", "valid_user_id", F.col("event_uid").alias("identity_event_uid")), _order()).alias("u")
    )
    profiles = _profile_sids(events.filter(F.lower("registry_hive") == "software"))
    sids = profiles.groupBy("case_id", "rid").agg(F.max_by("sid", _order()).alias("profile_sid"))
    machine = profiles.groupBy("case_id").agg(_machine_part(F.min_by("sid", _order())).alias("machine_sid"))
    decoded = records.select("case_id", "rid", decode_account_record(F.col("f_record")).alias("f"))
    return (
        users.join(decoded, ["case_id", "rid"], "left")
        .join(sids, ["case_id", "rid"], "left")
        .join(machine, "case_id", "left")
        .select(
            "case_id", "rid", "u.*", "f.*",
            F.coalesce("profile_sid", F.concat_ws("-", "machine_sid", F.col("rid").cast("string"))).alias("_sid"),
            "machine_sid", "profile_sid",
        )
        .withColumn("sid", F.when(F.coalesce("profile_sid", "machine_sid").isNotNull(), F.col("_sid")))
        .withColumn(
            "sid_derivation",
            F.when(F.col("profile_sid").isNull() & F.col("machine_sid").isNotNull(), "Machine SID + local RID"),
        )
        .drop("_sid", "profile_sid")
    )


