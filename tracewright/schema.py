"""Canonical event schema and the fixed values shared by all plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# The canonical event columns, in order.
EVENT_COLUMNS = [
    "event_uid",
    "schema_version",
    "case_id",
    "timestamp",
    "timestamp_type",
    "timestamp_source",
    "artifact_type",
    "event_type",
    "source_tool",
    "hostname",
    "username",
    "executable",
    "process_id",
    "command_line",
    "path",
    "target_path",
    "windows_event_id",
    "provider",
    "channel",
    "registry_hive",
    "registry_key",
    "registry_value_name",
    "registry_value_data",
    "mft_entry",
    "mft_sequence",
    "detection_rule",
    "severity",
    "description",
]

ATTRIBUTES_TYPE = T.MapType(T.StringType(), T.StringType())
PROVENANCE_TYPE = T.StructType(
    [
        T.StructField("parser", T.StringType()),
        T.StructField("parser_output", T.StringType()),
        T.StructField("source_evidence", T.StringType()),
        T.StructField("source_row", T.LongType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in EVENT_COLUMNS]
    + [
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("attributes", ATTRIBUTES_TYPE),
        T.StructField("provenance", PROVENANCE_TYPE),
    ]
)

# Tool -> evidence family. Two tools of one family are not
# independent evidence.
TOOL_FAMILIES = {
    "evtxecmd": "EVTX",
    "hayabusa": "EVTX",
    "mftecmd": "MFT",
    "pecmd": "PREFETCH",
    "recmd": "REGISTRY",
    "lecmd": "LNK",
}


def literal_map(values: dict[str, object]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def family_of(tool: Column) -> Column:
    """Evidence family of a tool; unknown tools form their own family."""
    return F.coalesce(F.try_element_at(literal_map(TOOL_FAMILIES), tool), F.upper(tool))


def conform(df: DataFrame) -> DataFrame:
    """Project onto the canonical schema: unknown columns are an error,
    missing text columns become blank."""
    unknown = set(df.columns) - set(EVENT_SCHEMA.names)
    if unknown:
        raise ValueError("unknown normalized field: " + ", ".join(sorted(unknown)))
    present = set(df.columns)
    columns = []
    for field in EVENT_SCHEMA.fields:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            columns.append(F.lit("").alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames by column name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def attribute_rows(events: DataFrame) -> DataFrame:
    """Key/value view of the attribute map."""
    return events.select(
        "event_uid", F.explode("attributes").alias("attribute_key", "attribute_value")
    )


def source_dimension(events: DataFrame) -> DataFrame:
    """Distinct sources with a stable hash key instead of a counter."""
    keys = ["case_id", "source_tool", "parser_output", "source_evidence"]
    rows = events.select(
        "case_id",
        "source_tool",
        F.col("provenance.parser_output").alias("parser_output"),
        F.col("provenance.source_evidence").alias("source_evidence"),
    ).distinct()
    blank_safe = [F.coalesce(F.col(k), F.lit("")) for k in keys]
    return rows.select(F.sha2(F.concat_ws("|", *blank_safe), 256).alias("source_id"), *keys)
