"""Phase progress from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.running import PART, range_parts, running

# Phases in order, and the patterns that announce them.
PHASES = [
    "Evidence Upload", "Prepare Case", "Artifact Collection", "Parsing", "Normalization", "System Telemetry",
    "SAM Telemetry", "Correlation", "Clustering", "Findings", "Investigation Context", "Fast Triage", "Qwen 4B", "RAG",
    "Deep Preparation", "Selective Qwen 8B", "Synthesis", "Final Report",
]
PHASE_PATTERNS = {
    "Prepare Case": r"PHASE 1 - IMAGE TO EVIDENCE\.DB|PREPARE CASE|prepare_case_from_image",
    "Artifact Collection": r"ARTIFACT COLLECTION|COLLECT|EvidenceReader|TRIAGE COLLECTOR|AD1",
    "Parsing": r"PARSING|EvtxECmd|Hayabusa|LECmd|PECmd|RECmd",
    "Normalization": r"NORMALIZATION|Finish normalization",
    "System Telemetry": r"SYSTEM TELEMETRY",
    "SAM Telemetry": r"SAM TELEMETRY",
    "Correlation": r"CORRELATION",
    "Clustering": r"CORE CLUSTERS|CANDIDATE CLUSTERS|clusters",
    "Findings": r"FINDINGS",
    "Investigation Context": r"INVESTIGATION CONTEXT",
    "Fast Triage": r"FAST TRIAGE",
    "Qwen 4B": r"QWEN4",
    "RAG": r"RAG",
    "Deep Preparation": r"DEEP PREPARATION|Prepare deep analysis",
    "Selective Qwen 8B": r"QWEN INVESTIGATOR|Qwen8 selective",
    "Synthesis": r"CASE SYNTHESIS|Prepare synthesis",
    "Final Report": r"FINAL DFIR REPORT|Final report",
}


def phase_index(line: Column) -> Column:
    """Index of the first phase whose pattern a line holds, else NULL."""
    out = F.lit(None).cast("int")
    for phase in reversed(PHASE_PATTERNS):
        out = F.when(line.rlike(f"(?i){PHASE_PATTERNS[phase]}"), F.lit(PHASES.index(phase))).otherwise(out)
    return out


def case_progress(lines: DataFrame, by: str = "case_id", line: str = "line") -> DataFrame:
    """Furthest phase per case. The index never goes back, so the state is a
    plain maximum: it merges across tasks and works unchanged on a stream."""
    reached = F.max(phase_index(F.col(line))).alias("phase_index")
    names = F.array(*[F.lit(p) for p in PHASES])
    return (
        lines.groupBy(by)
        .agg(reached)
        .filter(F.col("phase_index").isNotNull())
        .withColumn("phase", F.element_at(names, F.col("phase_index") + 1))
        .withColumn("percent", percent_of(F.col("phase_index")))
    )


def percent_of(index: Column) -> Column:
    return F.round(F.lit(100.0) * index / (len(PHASES) - 1), 1)


def line_progress(
    lines: DataFrame, order: list[str], by: str = "case_id", line: str = "line", carried: DataFrame | None = None
) -> DataFrame:
    """One row per log line that is not blank: the line's columns, detected, phase_index, phase, percent, started.

    ``detected`` is the index of the phase that the line announces (null if none), ``phase_index`` the furthest one so far in
    the order of ``order`` within the case (null before the first), ``started`` whether the line moves it on. ``carried`` is
    (``by``, reached): how far a case had come before. The furthest phase is a running maximum over ranges of lines, so a case
    may have any number of lines.
    """
    index = phase_index(F.col(line))
    parts = range_parts(lines.filter(F.trim(F.col(line)) != "").withColumn("detected", index), [by], order)
    seen = running(parts, [by], order, before=True, _before=("max", F.col("detected"))).drop(PART)
    if carried is not None:
        earlier = carried.select(F.col(by).alias("_case"), F.col("reached").alias("_reached"))
        seen = seen.join(earlier, F.col(by).eqNullSafe(F.col("_case")), "left")
        seen = seen.withColumn("_before", F.greatest("_before", "_reached")).drop("_case", "_reached")
    names = F.array(*[F.lit(p) for p in PHASES])
    reached = F.greatest("_before", "detected")
    started = F.coalesce(F.col("detected") > F.coalesce("_before", F.lit(-1)), F.lit(False))
    return (
        seen.withColumn("phase_index", reached)
        .withColumn("started", started)
        .withColumn("phase", F.when(F.col("phase_index").isNotNull(), F.element_at(names, F.col("phase_index") + 1)))
        .withColumn("percent", percent_of(F.col("phase_index")))
        .drop("_before")
    )
