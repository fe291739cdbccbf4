"""Windows event payloads: name/value extraction and observation texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.labels import first_match
from tracewright.functions.text import clean, nonblank

# Event ids with their labels.
AUTH_LABELS = {
    "4624": "Successful Logon",
    "4625": "Failed Logon",
    "4648": "Explicit Credential Use",
    "4672": "Special Privileges Assigned",
}
PERSISTENCE_LABELS = {
    "4697": "Service Installed - Security Log",
    "4698": "Scheduled Task Created",
    "4720": "Local User Account Created",
    "4728": "Member Added to Global Group",
    "4732": "Member Added to Local Group",
    "4740": "Account Locked Out",
    "7045": "Service Installed - System Log",
}

_ITEM = "struct<`@Name`:string,`#text`:string>"


def parse_event_payload(payload: Column) -> Column:
    """EventData.Data items of a JSON payload as a name to text map.

    Data may be a list or a single object; anything else gives an empty map.
    """
    raw = F.get_json_object(payload, "$.EventData.Data")
    items = F.coalesce(
        F.when(raw.startswith("["), F.from_json(raw, f"array<{_ITEM}>")),
        F.when(raw.startswith("{"), F.array(F.from_json(raw, _ITEM))),
    )
    named = F.filter(items, lambda i: clean(i["@Name"]) != "")
    entries = F.transform(named, lambda i: F.struct(clean(i["@Name"]), clean(i["#text"])))
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["col1"] == e["col1"]
        ),
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def without_blanks(values: Column) -> Column:
    """Map entries with a non-blank value."""
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def classify_auth_identity(username: Column) -> Column:
    """Class of a log user name."""
    value = clean(username)
    low = F.lower(value)
    service = low.endswith("$")
    for term in ("\\system", "network service", "local service", "window manager\\", "font driver host\\"):
        service = service | low.contains(term)
    return F.when((value == "") | (value == "-\\-"), "UNKNOWN").when(service, "SYSTEM / SERVICE").otherwise(
        "USER / OTHER"
    )


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def persistence_observation(event_id: Column, payload: Column, attributes: Column) -> Column:
    """Readable text of a persistence or account event.

    ``payload`` is a map column without blank values.
    """

    def field(name: str) -> Column:
        return F.try_element_at(payload, F.lit(name))

    def attr(name: str) -> Column:
        return nonblank(F.try_element_at(attributes, F.lit(name)))

    target, domain = field("TargetUserName"), field("TargetDomainName")
    qualified = F.coalesce(F.concat(domain, F.lit("\\"), target), target, F.lit("UNKNOWN"))
    service_parts = [
        _labelled("Service: ", field("ServiceName")),
        _labelled("Image: ", F.coalesce(field("ImagePath"), attr("executable_info"))),
        _labelled("Start: ", field("StartType")),
        _labelled("Account: ", field("AccountName")),
    ]
    service = F.when(F.coalesce(*service_parts).isNotNull(), F.concat_ws(" | ", *service_parts))
    member = F.coalesce(F.when(field("MemberName") != "-", field("MemberName")), field("MemberSid"))
    task = F.coalesce(field("TaskName"), field("TaskContent"))
    return (
        F.when(event_id == "7045", F.coalesce(service, F.lit("Service installation event")))
        .when(
            event_id == "4720",
            F.concat_ws(" | ", _labelled("Account created: ", qualified), _labelled("SID: ", field("TargetSid"))),
        )
        .when(
            event_id.isin("4728", "4732"),
            F.concat_ws(" | ", _labelled("Group: ", qualified), _labelled("Member: ", member)),
        )
        .when(
            event_id == "4698",
            F.coalesce(_labelled("Scheduled task: ", task), F.lit("Scheduled task created")),
        )
        .when(
            event_id == "4740",
            F.coalesce(_labelled("Account locked: ", target), F.lit("Account lockout event")),
        )
        .otherwise(F.coalesce(attr("map_description"), F.lit("Windows security event")))
    )


def finding_theme(title: Column) -> Column:
    """Theme of a finding title; the first rule that holds decides."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return first_match(
        [
            (low.contains("service"), "Service / Execution Activity"),
            (low.rlike("rdp|remote logon|remote access"), "Remote Access Activity"),
            (low.rlike("admin|group|password|account|ntlm"), "Identity / Privilege Activity"),
            (low.rlike("firewall|wmi|dc shadow"), "System / Configuration Activity"),
        ],
        "Other Investigation Activity",
    )


def normalize_statement(text: Column) -> Column:
    """Comparison key of a statement: lower case, blanks collapsed, most
    punctuation dropped."""
    low = F.lower(clean(text))
    spaced = F.regexp_replace(low, r"(?U)\s+", " ")
    return clean(F.regexp_replace(spaced, r"(?U)[^\w\\./:$%-]+", " "))


def clean_recommendation(value: Column) -> Column:
    """Recommendation text: action and reason of a JSON object, or plain text
    without index debris."""
    stripped = clean(value)
    as_object = F.when(
        stripped.startswith("{") & stripped.endswith("}"),
        F.from_json(stripped, "struct<action:string,reason:string>"),
    )
    is_object = F.get_json_object(stripped, "$").isNotNull() & stripped.startswith("{")
    action, reason = nonblank(as_object["action"]), nonblank(as_object["reason"])
    from_object = F.coalesce(F.concat(action, F.lit(" Reason: "), reason), action, F.lit(""))
    plain = stripped
    # Debris patterns.
    for pattern in (
        r'(?i),?\s*"target_evidence"\s*:\s*"[^"]*"',
        r"(?i)\bevidence_indexes?\s*:\s*\[[^\]]*\]",
        r"(?i)\bevidence_indexes?\s*:\s*\d+",
        r"(?i)\bevidence_index_?\d+\b",
    ):
        plain = F.regexp_replace(plain, pattern, "")
    return F.when(is_object, from_object).otherwise(F.btrim(plain, F.lit(" ,{}")))


def recommendation_key(text: Column) -> Column:
    """Comparison key of a recommendation: its action part."""
    return normalize_statement(F.split(text, "Reason:", 2)[0])
