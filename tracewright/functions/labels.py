"""Rule-based labels: scores, severities and keyword classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import clean, norm_text
from tracewright.schema import literal_map

# Severity spellings and ranks.
SEVERITY_SPELLINGS = {
    "informational": "INFO",
    "information": "INFO",
    "info": "INFO",
    "low": "LOW",
    "medium": "MEDIUM",
    "med": "MEDIUM",
    "high": "HIGH",
    "critical": "CRITICAL",
    "crit": "CRITICAL",
}
SEVERITY_RANKS = {"UNKNOWN": -1, "INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def lookup(values: dict[str, object], key: Column, default: object) -> Column:
    """Constant table lookup with a default."""
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def confidence_from_score(score: Column) -> Column:
    """Score to confidence band."""
    return (
        F.when(score >= 0.90, "VERY_HIGH")
        .when(score >= 0.80, "HIGH")
        .when(score >= 0.70, "MEDIUM")
        .otherwise("LOW")
    )


def normalize_severity(value: Column | str) -> Column:
    """Severity spelling to one of six levels."""
    return lookup(SEVERITY_SPELLINGS, norm_text(value), "UNKNOWN")


def severity_rank(level: Column) -> Column:
    """Numeric rank of a normalized severity."""
    return lookup(SEVERITY_RANKS, level, -1)


def same_text(left: Column, right: Column) -> Column:
    """Both sides non-blank and equal ignoring case and outer blanks."""
    a, b = norm_text(left), norm_text(right)
    return (a != "") & (a == b)


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    (condition, value), *rest = rules
    chain = F.when(condition, F.lit(value))
    for condition, value in rest:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))


def contains_any(text: Column, terms: list[str]) -> Column:
    """True where the text holds any of the plain terms."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def command_lead_kind(command: Column | str) -> Column:
    """Lead class of a shell command, NULL where no rule holds."""
    low = norm_text(command)
    return first_match(
        [
            (contains_any(low, ["drivers\\etc\\hosts", "drivers/etc/hosts"]), "hosts file modification"),
            (low.contains("disablerealtimemonitoring"), "Defender real-time monitoring change"),
            (
                low.contains("add-mppreference") & low.contains("exclusionpath"),
                "Defender exclusion change",
            ),
            (low.contains("noautoupdate"), "Windows Update policy change"),
        ]
    )


__all__ = [
    "SEVERITY_RANKS",
    "clean",
    "command_lead_kind",
    "confidence_from_score",
    "contains_any",
    "first_match",
    "lookup",
    "normalize_severity",
    "same_text",
    "severity_rank",
]
