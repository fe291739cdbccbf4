"""Parser outputs (CSV, JSON lines) to canonical events.

Each adapter is ``(spark, path, case_id, ...) -> DataFrame`` and stays narrow:
scan, project, unpivot. Only record numbering adds a join against one row per
file split.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import clean, first_nonempty, nonblank
from tracewright.functions.times import canonical_ts
from tracewright.schema import SCHEMA_VERSION, conform
from tracewright.sources.records import quoted_records

# Timestamp column -> (event type, origin), per tool.
MFT_TIMES = {
    "Created0x10": ("FILE_CREATED", "STANDARD_INFORMATION"),
    "Created0x30": ("FILE_CREATED", "FILE_NAME"),
    "LastModified0x10": ("FILE_MODIFIED", "STANDARD_INFORMATION"),
    "LastModified0x30": ("FILE_MODIFIED", "FILE_NAME"),
    "LastRecordChange0x10": ("FILE_RECORD_CHANGED", "STANDARD_INFORMATION"),
    "LastRecordChange0x30": ("FILE_RECORD_CHANGED", "FILE_NAME"),
    "LastAccess0x10": ("FILE_ACCESSED", "STANDARD_INFORMATION"),
    "LastAccess0x30": ("FILE_ACCESSED", "FILE_NAME"),
}
LNK_TIMES = {
    "SourceCreated": ("LNK_CREATED", "LNK_SOURCE"),
    "SourceModified": ("LNK_MODIFIED", "LNK_SOURCE"),
    "SourceAccessed": ("LNK_ACCESSED", "LNK_SOURCE"),
    "TargetCreated": ("TARGET_CREATED", "LNK_TARGET_METADATA"),
    "TargetModified": ("TARGET_MODIFIED", "LNK_TARGET_METADATA"),
    "TargetAccessed": ("TARGET_ACCESSED", "LNK_TARGET_METADATA"),
}
RUN_TIMES = ["LastRun", *[f"PreviousRun{i}" for i in range(7)]]

# Required header columns per tool.
REQUIRED = {
    "mftecmd": ["EntryNumber", "SequenceNumber", "ParentPath", "FileName", "SourceFile", *MFT_TIMES],
    "evtxecmd": [
        "RecordNumber", "EventRecordId", "TimeCreated", "EventId", "Provider", "Channel", "ProcessId", "Computer",
        "UserName", "RemoteHost", "SourceFile", "Payload",
    ],
    "pecmd": ["SourceFilename", "ExecutableName", "Hash", "RunCount", *RUN_TIMES],
    "recmd": [
        "HivePath", "HiveType", "Category", "KeyPath", "ValueName", "ValueType", "ValueData", "LastWriteTimestamp",
        "Deleted",
    ],
    "lecmd": ["SourceFile", *LNK_TIMES, "LocalPath", "RelativePath"],
}

# Attribute name -> source column, per tool.
MFT_ATTRIBUTES = {
    "sequence_number": "SequenceNumber", "parent_entry_number": "ParentEntryNumber",
    "parent_sequence_number": "ParentSequenceNumber", "file_name": "FileName", "extension": "Extension",
    "file_size": "FileSize", "in_use": "InUse", "is_directory": "IsDirectory", "has_ads": "HasAds", "is_ads": "IsAds",
    "si_less_than_fn": "SI<FN", "copied": "Copied", "si_flags": "SiFlags", "name_type": "NameType",
    "update_sequence_number": "UpdateSequenceNumber", "logfile_sequence_number": "LogfileSequenceNumber",
    "zone_id_contents": "ZoneIdContents",
}
LOG_ATTRIBUTES = {
    "record_number": "RecordNumber", "event_record_id": "EventRecordId", "level": "Level", "thread_id": "ThreadId",
    "chunk_number": "ChunkNumber", "user_id": "UserId", "map_description": "MapDescription",
    "remote_host": "RemoteHost", "executable_info": "ExecutableInfo", "hidden_record": "HiddenRecord",
    "keywords": "Keywords", "extra_data_offset": "ExtraDataOffset", "payload": "Payload",
}
PREFETCH_ATTRIBUTES = {
    "prefetch_hash": "Hash", "run_count": "RunCount", "prefetch_version": "Version", "prefetch_size": "Size",
    "source_created": "SourceCreated", "source_modified": "SourceModified", "source_accessed": "SourceAccessed",
    "volume0_name": "Volume0Name", "volume0_serial": "Volume0Serial", "volume0_created": "Volume0Created",
    "volume1_name": "Volume1Name", "volume1_serial": "Volume1Serial", "volume1_created": "Volume1Created",
    "directories": "Directories", "files_loaded": "FilesLoaded", "parsing_error": "ParsingError", "note": "Note",
}
REGISTRY_ATTRIBUTES = {
    "hive_type": "HiveType", "category": "Category", "value_type": "ValueType", "deleted": "Deleted",
    "description": "Description", "comment": "Comment", "plugin_name": "PluginName",
}
LNK_ATTRIBUTES = {
    "relative_path": "RelativePath", "local_path": "LocalPath", "working_directory": "WorkingDirectory",
    "arguments": "Arguments", "file_size": "FileSize", "header_flags": "HeaderFlags",
    "file_attributes": "FileAttributes", "drive_type": "DriveType", "volume_serial_number": "VolumeSerialNumber",
    "volume_label": "VolumeLabel", "machine_id": "MachineID", "mac_address": "MacAddress",
    "tracker_created_on": "TrackerCreatedOn", "target_mft_entry": "TargetMFTEntryNumber",
    "target_mft_sequence": "TargetMFTSequenceNumber",
}
# Detection fields kept as text and kept as given.
DETECTION_TEXT = {
    "rule_title": "RuleTitle", "details": "Details", "record_id": "RecordID", "rule_file": "RuleFile",
    "evtx_file": "EvtxFile",
}
DETECTION_RAW = {
    "tags": "Tags", "mitre_tactics": "MitreTactics", "mitre_tags": "MitreTags", "other_tags": "OtherTags",
    "rule_author": "RuleAuthor", "rule_creation_date": "RuleCreationDate", "rule_modified_date": "RuleModifiedDate",
    "status": "Status",
}
DETECTION_FIELDS = [
    "Timestamp", "EventID", "Channel", "Computer", "Level", *DETECTION_TEXT.values(), *DETECTION_RAW.values(),
]


class MissingColumns(ValueError):
    """A parser output lacks required header columns."""


def require_columns(df: DataFrame, tool: str) -> DataFrame:
    """Fail when a required header column is missing."""
    missing = sorted(set(REQUIRED[tool]) - set(df.columns))
    if missing:
        raise MissingColumns(f"{tool} output is missing required fields: {', '.join(missing)}")
    return df


def number_records(df: DataFrame, first: int) -> DataFrame:
    """Add ``source_row`` and ``source_file`` to a fresh file scan.

    Records are numbered per file in file order. Every task numbers its split
    locally; the splits' sizes, one row per split, give the offsets. The file
    is never gathered in one task.
    """
    located = df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "_start", F.col("_metadata.file_block_start")
    ).withColumn("_id", F.monotonically_increasing_id())
    splits = located.groupBy("_file", "_start").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_start", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        located.join(offsets, ["_file", "_start"])
        .withColumn("source_row", F.col("_before") + F.col("_id") - F.col("_low") + first)
        .withColumn("source_file", F.regexp_replace(plain_path(F.col("_file")), r"^file:(//)?", ""))
        .drop("_file", "_start", "_id", "_low", "_before")
    )


def plain_path(url: Column) -> Column:
    """The file path of a location that a scan reports."""
    return F.url_decode(F.regexp_replace(url, r"\+", "%2B"))


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, header): the first line of every file with a line. Numbers tell which it is, so no line is sorted for it."""
    lines = spark.read.text(paths).select(
        "value", plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min("id").alias("id"))
    return lines.join(F.broadcast(first.select("id")), "id").select("file", F.col("value").alias("header"))


def files_by_header(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Files grouped by their first line; one line per file reaches the driver, like a listing."""
    grouped = first_lines(spark, paths).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return {row["header"]: row["files"] for row in sorted(grouped.collect(), key=lambda row: row["files"])}


# How fields are quoted; empty fields are null, quoted empty ones are empty texts.
CSV_OPTIONS = {"quote": '"', "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def header_names(header: str) -> list[str]:
    """Column names of a header line; a name that comes again gets its position."""
    names = next(csv.reader([header.removeprefix("\ufeff")]), [])
    return [name if names.index(name) == i else f"{name}{i}" for i, name in enumerate(names)]


def read_csv(spark: SparkSession, paths: str | list[str], tool: str, *, multiline: bool = True) -> DataFrame:
    """Text columns of CSV files with a header, numbered from 2.

    Files may order their columns differently or lack optional ones: files with
    the same header are one scan, every header must hold the required columns,
    and the scans are joined by column name. Files without any line are skipped.
    Huge files are read by many tasks, also where fields hold line breaks; ``multiline=False``
    says that none does, and saves the passes that look for them.
    """

    def plain(header: str, files: list[str]) -> DataFrame:
        found = spark.read.csv(files, header=True, inferSchema=False, **{**CSV_OPTIONS, "multiLine": False})
        return number_records(require_columns(found, tool), 2)

    def quoted(header: str, files: list[str]) -> DataFrame:
        fields = T.StructType([T.StructField(name, T.StringType()) for name in header_names(header)])
        require_columns(spark.createDataFrame([], fields), tool)
        rows = quoted_records(spark, files).filter(F.col("number") > 1)
        parsed = F.from_csv("value", fields.toDDL(), {**CSV_OPTIONS, "multiLine": "true", "lineSep": "\n"})
        return rows.select(
            parsed.alias("_r"), F.col("number").alias("source_row"), F.regexp_replace(plain_path(F.col("file")), r"^file:(//)?", "").alias("source_file")
        ).select("_r.*", "source_row", "source_file")

    groups = files_by_header(spark, paths)
    scans = [(quoted if multiline else plain)(header, files) for header, files in groups.items()]
    if not scans:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in REQUIRED[tool]) + ", source_row long, source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _text(df: DataFrame, name: str) -> Column:
    return clean(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def _attributes(df: DataFrame, names: dict[str, str], **extra: Column) -> Column:
    pairs = [x for key, column in names.items() for x in (F.lit(key), _text(df, column))]
    pairs += [x for key, column in extra.items() for x in (F.lit(key), column)]
    return F.create_map(*pairs)


def limit_rows(df: DataFrame, start_row: int | None, max_row: int | None) -> DataFrame:
    """Keep source rows of a closed range."""
    if start_row is not None:
        df = df.filter(F.col("source_row") >= start_row)
    if max_row is not None:
        df = df.filter(F.col("source_row") <= max_row)
    return df


def unpivot_times(df: DataFrame, times: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per non-blank timestamp column: adds time_field, event_type,
    origin and timestamp."""
    choices = F.array(
        *[
            F.struct(
                F.lit(name).alias("time_field"), F.lit(kind).alias("event_type"), F.lit(origin).alias("origin"),
                clean(F.col(f"`{name}`")).alias("timestamp"),
            )
            for name, (kind, origin) in times.items()
        ]
    )
    present = F.filter(choices, lambda c: c["timestamp"] != "")
    rows = df.select("*", F.explode_outer(present).alias("_t")).filter(F.col("_t").isNotNull())
    return rows.select("*", "_t.*").drop("_t")


def finish(
    df: DataFrame, case_id: str, tool: str, *, parser_output: str | None, discriminator: Column | None = None, **fields: Column
) -> DataFrame:
    """Identity, provenance and canonical projection.

    The event key hashes the logical output name, the record number, the time
    and the type, so the same record gives the same key on every run.
    """
    output = F.lit(parser_output) if parser_output is not None else F.col("source_file")
    parts = [
        F.lit(case_id), F.lit(tool), output, F.col("source_row").cast("string"), fields["timestamp_type"],
        fields["timestamp"], fields["event_type"],
    ]
    if discriminator is not None:
        parts.append(discriminator)
    return conform(
        df.select(
            F.sha2(F.concat_ws("|", *parts), 256).alias("event_uid"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.lit(case_id).alias("case_id"),
            F.lit(tool).alias("source_tool"),
            canonical_ts(fields["timestamp"]).alias("event_ts"),
            F.struct(
                F.lit(tool).alias("parser"), output.alias("parser_output"),
                fields.pop("source_evidence").alias("source_evidence"), F.col("source_row").alias("source_row"),
            ).alias("provenance"),
            *[column.alias(name) for name, column in fields.items()],
        )
    )


def mft_path(parent: Column, name: Column) -> Column:
    """Parent and name joined; a blank or dot parent is dropped."""
    return (
        F.when((parent == "") | (parent == "."), name)
        .when(parent.endswith("\\"), F.concat(parent, name))
        .otherwise(F.concat(parent, F.lit("\\"), name))
    )


def mft_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None, multiline=True) -> DataFrame:
    """File-table rows, one event per non-blank timestamp."""
    raw = limit_rows(read_csv(spark, paths, "mftecmd", multiline=multiline), start_row, max_row)
    rows = unpivot_times(raw, MFT_TIMES)
    field, origin = F.col("time_field"), F.col("origin")
    return finish(
        rows, case_id, "mftecmd", parser_output=parser_output,
        timestamp=F.col("timestamp"), timestamp_type=F.col("event_type"), event_type=F.col("event_type"),
        timestamp_source=F.concat(F.lit("MFT."), field), artifact_type=F.lit("mft"),
        source_evidence=_text(raw, "SourceFile"),
        path=mft_path(_text(raw, "ParentPath"), _text(raw, "FileName")),
        mft_entry=_text(raw, "EntryNumber"), mft_sequence=_text(raw, "SequenceNumber"),
        description=F.concat(F.col("event_type"), F.lit(" timestamp from "), origin),
        attributes=_attributes(raw, MFT_ATTRIBUTES, timestamp_origin=origin, timestamp_field=field),
    )


def log_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None, multiline=True) -> DataFrame:
    """Windows log rows with a creation time."""
    raw = limit_rows(read_csv(spark, paths, "evtxecmd", multiline=multiline), start_row, max_row)
    rows = raw.filter(_text(raw, "TimeCreated") != "")
    event_id = _text(raw, "EventId")
    packed = [x for i in range(1, 7) for x in (F.lit(f"PayloadData{i}"), nonblank(_text(raw, f"PayloadData{i}")))]
    payload_data = F.to_json(F.map_filter(F.create_map(*packed), lambda _, v: v.isNotNull()))
    return finish(
        rows, case_id, "evtxecmd", parser_output=parser_output,
        timestamp=_text(raw, "TimeCreated"), timestamp_type=F.lit("EVENT_CREATED"), event_type=F.lit("WINDOWS_EVENT"),
        timestamp_source=F.lit("EVTX.TimeCreated"), artifact_type=F.lit("evtx"),
        source_evidence=_text(raw, "SourceFile"), hostname=_text(raw, "Computer"), username=_text(raw, "UserName"),
        process_id=_text(raw, "ProcessId"), windows_event_id=event_id, provider=_text(raw, "Provider"),
        channel=_text(raw, "Channel"),
        description=F.when(event_id != "", F.concat(F.lit("Windows Event ID "), event_id)).otherwise("Windows event"),
        attributes=_attributes(raw, LOG_ATTRIBUTES, payload_data=payload_data),
    )


def prefetch_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None, multiline=True) -> DataFrame:
    """Prefetch rows, one event per non-blank run time; the run field is part
    of the identity because equal times are distinct runs."""
    raw = limit_rows(read_csv(spark, paths, "pecmd", multiline=multiline), start_row, max_row)
    rows = unpivot_times(raw, {name: ("PROGRAM_EXECUTION", "") for name in RUN_TIMES})
    field = F.col("time_field")
    return finish(
        rows, case_id, "pecmd", parser_output=parser_output, discriminator=field,
        timestamp=F.col("timestamp"), timestamp_type=F.lit("EXECUTION_TIME"), event_type=F.col("event_type"),
        timestamp_source=F.concat(F.lit("Prefetch."), field), artifact_type=F.lit("prefetch"),
        source_evidence=_text(raw, "SourceFilename"), executable=_text(raw, "ExecutableName"),
        description=F.concat(F.lit("Program execution timestamp from Prefetch "), field),
        attributes=_attributes(raw, PREFETCH_ATTRIBUTES, run_timestamp_field=field),
    )


def registry_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None, multiline=True) -> DataFrame:
    """Registry rows of one or many files with a last-write time."""
    raw = limit_rows(read_csv(spark, paths, "recmd", multiline=multiline), start_row, max_row)
    rows = raw.filter(_text(raw, "LastWriteTimestamp") != "")
    kind = F.lit("REGISTRY_KEY_LAST_WRITE")
    return finish(
        rows, case_id, "recmd", parser_output=parser_output,
        timestamp=_text(raw, "LastWriteTimestamp"), timestamp_type=kind, event_type=kind,
        timestamp_source=F.lit("Registry.LastWriteTimestamp"), artifact_type=F.lit("registry"),
        source_evidence=_text(raw, "HivePath"), registry_hive=_text(raw, "HiveType"),
        registry_key=_text(raw, "KeyPath"), registry_value_name=_text(raw, "ValueName"),
        registry_value_data=_text(raw, "ValueData"), description=F.lit("Registry key LastWrite observation"),
        attributes=_attributes(raw, REGISTRY_ATTRIBUTES),
    )


def shortcut_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None, multiline=True) -> DataFrame:
    """Shortcut rows, one event per non-blank timestamp."""
    raw = limit_rows(read_csv(spark, paths, "lecmd", multiline=multiline), start_row, max_row)
    rows = unpivot_times(raw, LNK_TIMES)
    field, origin = F.col("time_field"), F.col("origin")
    return finish(
        rows, case_id, "lecmd", parser_output=parser_output,
        timestamp=F.col("timestamp"), timestamp_type=F.col("event_type"), event_type=F.col("event_type"),
        timestamp_source=F.concat(F.lit("LNK."), field), artifact_type=F.lit("lnk"),
        source_evidence=_text(raw, "SourceFile"), path=_text(raw, "SourceFile"),
        target_path=first_nonempty("LocalPath", "RelativePath"),
        mft_entry=_text(raw, "TargetMFTEntryNumber"), mft_sequence=_text(raw, "TargetMFTSequenceNumber"),
        description=F.concat(F.col("event_type"), F.lit(" timestamp from "), origin),
        attributes=_attributes(raw, LNK_ATTRIBUTES, timestamp_origin=origin, timestamp_field=field),
    )


def read_detections(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejected rows) of detection JSON lines, numbered from 1.

    Blank lines count as rows but give nothing; malformed lines go to the
    reject table (source_file, source_row, value, reason).
    """
    lines = number_records(spark.read.text(paths), 1)
    lines = lines.withColumn("value", F.regexp_replace(clean("value"), "^﻿", "")).filter(F.col("value") != "")
    fields = ", ".join(f"`{name}` string" for name in DETECTION_FIELDS)
    parsed = lines.withColumn(
        "_r", F.from_json("value", f"{fields}, `_bad` string", {"columnNameOfCorruptRecord": "_bad"})
    )
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    rejects = parsed.filter(bad).select("source_file", "source_row", "value", F.lit("malformed JSON").alias("reason"))
    return parsed.filter(~bad).select("source_file", "source_row", "_r.*").drop("_bad"), rejects


def detection_events(spark, paths, case_id, *, parser_output=None, start_row=None, max_row=None) -> DataFrame:
    """Detection rows with a timestamp; list fields stay JSON text."""
    raw = limit_rows(read_detections(spark, paths)[0], start_row, max_row)
    rows = raw.filter(_text(raw, "Timestamp") != "")
    kept = [x for key, name in DETECTION_RAW.items() for x in (F.lit(key), F.col(name))]
    text = [x for key, name in DETECTION_TEXT.items() for x in (F.lit(key), _text(raw, name))]
    title = _text(raw, "RuleTitle")
    return finish(
        rows, case_id, "hayabusa", parser_output=parser_output,
        timestamp=_text(raw, "Timestamp"), timestamp_type=F.lit("EVENT_TIME"), event_type=F.lit("DETECTION"),
        timestamp_source=F.lit("Hayabusa.Timestamp"), artifact_type=F.lit("hayabusa_detection"),
        source_evidence=_text(raw, "EvtxFile"), hostname=_text(raw, "Computer"),
        windows_event_id=_text(raw, "EventID"), channel=_text(raw, "Channel"), detection_rule=title,
        severity=_text(raw, "Level"),
        description=F.when(title != "", title).otherwise("Hayabusa detection"),
        attributes=F.create_map(*text, *kept),
    )


ADAPTERS = {
    "mftecmd": mft_events,
    "evtxecmd": log_events,
    "pecmd": prefetch_events,
    "recmd": registry_events,
    "lecmd": shortcut_events,
    "hayabusa": detection_events,
}


def split_unparseable(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with a usable time, events whose time text cannot be read)."""
    return events.filter(F.col("event_ts").isNotNull()), events.filter(F.col("event_ts").isNull())
