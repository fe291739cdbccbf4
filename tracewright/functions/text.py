"""Text, path and attribute scalars as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters removed by a blank-trim.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# ASCII characters that canonical attribute names drop.
ASCII_SEPARATORS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())

# Patterns.
PREFETCH_NAME = r"(?i)^(.+?\.exe)-[0-9a-f]{8}\.pf$"
EXE_IN_TEXT = r"(?i)((?:[A-Z]:\\|\\Device\\)[^\r\n\"';,]*?\.exe\b)"

# Paths that never link events.
GENERIC_PATH_KEYS = ["\\", "$mft"]


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim(value: Column | str) -> Column:
    """Strip whitespace at both ends; NULL stays NULL."""
    return F.btrim(_c(value), F.lit(WHITESPACE))


def clean(value: Column | str) -> Column:
    """Trimmed text, NULL becomes blank."""
    return trim(F.coalesce(_c(value).cast("string"), F.lit("")))


def nonblank(value: Column | str) -> Column:
    """Trimmed text, blank becomes NULL."""
    text = trim(_c(value).cast("string"))
    return F.when(text != "", text)


def norm_text(value: Column | str) -> Column:
    """Trimmed lower-case text."""
    return F.lower(clean(value))


def collapse(value: Column | str) -> Column:
    """Lower-case text with whitespace runs collapsed to one blank."""
    return trim(F.regexp_replace(F.lower(F.coalesce(_c(value), F.lit(""))), r"\s+", " "))


def first_nonempty(*values: Column | str) -> Column:
    """First value that is not blank, else blank."""
    return F.coalesce(*[nonblank(v) for v in values], F.lit(""))


def norm_path(value: Column | str) -> Column:
    """Unquoted, backslash-only, lower-case path."""
    bare = F.lower(F.translate(F.btrim(F.btrim(clean(value), F.lit('"')), F.lit("'")), "/", "\\"))
    return F.when(bare.contains("\\\\"), F.regexp_replace(bare, r"\\+", r"\\")).otherwise(bare)


def last_segment(path: Column) -> Column:
    """Text after the last backslash; a bare drive prefix is dropped."""
    bare_drive = ~path.contains("\\") & (F.substring(path, 2, 1) == ":")
    return F.when(bare_drive, F.substring(path, F.lit(3), F.length(path))).otherwise(
        F.substring_index(path, "\\", -1)
    )


def norm_executable(value: Column | str) -> Column:
    """Base name of a normalized path."""
    return last_segment(norm_path(value))


def basename(value: Column | str) -> Column:
    """Lower-case base name of a raw path."""
    return F.lower(last_segment(F.translate(clean(value), "/", "\\")))


def _tagged(value: Column, tag: str) -> Column:
    return F.when(value != "", F.concat(F.lit(tag), value)).otherwise("") if tag else value


def _key_list(values: list[Column], tag: str) -> Column:
    return F.array_remove(F.array_distinct(F.array(*[_tagged(v, tag) for v in values])), "")


def linkable_paths(*normalized: Column | str, tag: str = "") -> Column:
    """Distinct linkable keys of normalized paths, each with ``tag`` in front."""

    def linkable(path: Column) -> Column:
        return F.when((F.length(path) >= 3) & ~path.isin(GENERIC_PATH_KEYS), path).otherwise("")

    return _key_list([linkable(_c(p)) for p in normalized], tag)


def path_keys(*paths: Column | str) -> Column:
    """Distinct linkable path keys of raw paths."""
    return linkable_paths(*[norm_path(p) for p in paths])


def _prefetch_name(name: Column) -> Column:
    return F.when(name.endswith(".pf"), F.lower(F.regexp_extract(name, PREFETCH_NAME, 1))).otherwise("")


def executable_names(*normalized: Column | str, text: Column | None = None, tag: str = "") -> Column:
    """Distinct executable names of normalized paths and of free text that may
    hold executable paths, each with ``tag`` in front.

    Plain columns stay in generated code; only text with a match goes through
    array lambdas.
    """
    names = [last_segment(_c(v)) for v in normalized]
    keys = _key_list([*names, *[_prefetch_name(n) for n in names]], tag)
    if text is None:
        return keys
    held = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(held, F.lit(EXE_IN_TEXT), F.lit(1))
    # An .exe name is its own key: it can never look like a prefetch file name.
    more = F.transform(found, lambda v: F.concat(F.lit(tag), norm_executable(v)))
    return F.when(F.lower(held).contains(".exe"), F.array_union(keys, more)).otherwise(keys)


def executable_keys(
    executable: Column | str,
    path: Column | str,
    target_path: Column | str,
    *extra: Column,
    text: Column | None = None,
) -> Column:
    """Distinct executable names a row of raw columns refers to."""
    return executable_names(*[norm_path(v) for v in (executable, path, target_path, *extra)], text=text)


def canonical_attribute_key(value: Column) -> Column:
    """Attribute name reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def canonical_attributes(attributes: Column | str) -> Column:
    """Attribute map under canonical keys with trimmed values.

    Two names may reduce to one key; the later entry of the map wins.
    """
    entries = F.transform(
        F.map_entries(_c(attributes)),
        lambda e: F.struct(
            canonical_attribute_key(e["key"]).alias("key"), clean(e["value"]).alias("value")
        ),
    )
    last_wins = F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])
        ),
    )
    return F.coalesce(last_wins, F.create_map().cast("map<string,string>"))


def attribute(attributes: Column | str, *names: str) -> Column:
    """First non-blank attribute among aliases, compared by canonical key, in
    one pass over the map. Rows whose keys hold no alias skip that pass."""
    canonical = ["".join(ch for ch in n.lower() if ch.isalnum()) for n in names]
    wanted = F.array(*[F.lit(n) for n in dict.fromkeys(canonical)])
    found = F.transform(
        F.map_entries(_c(attributes)),
        lambda e, i: F.struct(
            F.array_position(wanted, canonical_attribute_key(e["key"])).alias("alias"),
            (-i).alias("back"),
            clean(e["value"]).alias("value"),
        ),
    )
    best = F.array_min(F.filter(found, lambda x: (x["alias"] > 0) & (x["value"] != "")))
    joined = F.lower(F.concat_ws("|", F.map_keys(_c(attributes))))
    plain = F.translate(joined, ASCII_SEPARATORS, "")
    present = F.length(joined) != F.octet_length(joined)
    for name in dict.fromkeys(canonical):
        present = present | plain.contains(name)
    return F.when(present, F.coalesce(best["value"], F.lit(""))).otherwise("")


def short(value: Column | str, limit: int) -> Column:
    """Trimmed text cut to ``limit`` characters with a marker."""
    text = clean(value)
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("...[truncated]"))
    ).otherwise(text)


def json_list(value: Column | str) -> Column:
    """JSON text to an array of text; anything else is an empty array."""
    parsed = F.from_json(_c(value), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def dedupe_ci(values: Column) -> Column:
    """Distinct trimmed texts ignoring case, first spelling and order kept."""
    trimmed = F.filter(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), clean),
        lambda v: v != "",
    )
    return F.filter(
        trimmed,
        lambda v, i: F.array_position(F.transform(trimmed, F.lower), F.lower(v)) == i + 1,
    )


def serialize_attribute(value: Column, *, structured: bool = False) -> Column:
    """Attribute value as text: compact JSON for nested values."""
    return F.to_json(value) if structured else value.cast("string")
