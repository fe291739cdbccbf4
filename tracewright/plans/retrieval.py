"""Vector search over historical chunks, reranking and context selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.labels import contains_any, lookup
from tracewright.functions.text import clean, dedupe_ci, nonblank
from tracewright.operators.skew import top_n
from tracewright.operators.vectors import cell_search

# Result sizes, minimum text length, query caps.
SEARCH_K, REPORT_K = 8, 4
RERANK_K, RERANK_POOL = 10, 120
CONTEXT_K, MIN_CONTEXT_CHARS = 6, 300
LIST_VALUES, QUERY_CHARS = 8, 3000

# Question signals, device terms and phase bonuses.
DEVICE_SIGNALS = [
    "network appliance", "network infrastructure appliance", "network infrastructure", "network device",
    "infrastructure device", "router", "switch", "firewall appliance", "network controller",
]
DEVICE_TERMS = [
    "network appliance", "network device", "controller", "sd-wan", "router", "switch", "firewall", "ssh", "peering",
    "configuration", "administrative account", "admin account", "device configuration", "control plane",
]
DEVICE_STEP, DEVICE_CAP = 0.025, 0.150
PRE_IMPACT_SIGNALS = [
    "no ransomware", "ransomware has not", "ransomware hasn't", "before ransomware", "before impact",
    "prior to ransomware", "prior to impact", "ransomware precursor", "ransomware precursors",
    "progressing toward ransomware", "progressing to ransomware", "leading to ransomware", "escalation before impact",
]
PHASE_BONUS = {
    "credential_access": 0.055, "privilege_escalation": 0.050, "lateral_movement": 0.050, "defense_evasion": 0.045,
    "discovery": 0.040, "collection": 0.040, "persistence": 0.035, "command_and_control": 0.035, "execution": 0.025,
    "initial_access": 0.015, "impact": -0.080,
}
HISTORICAL_TERMS = [
    "zero.exe", "psexec", "wmic", "cobalt strike", "metasploit", "zerologon", "cve-2020-1472", "rustscan", "nmap",
]
HISTORY_MARKERS = ["5. **historical examples**", "5. historical examples"]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, **options: int) -> DataFrame:
    """Exact cosine top-k: (query_id, doc_id, score), score rounded to 6 digits, ties to the smaller id.

    ``queries`` is (query_id, vector), ``corpus`` is (doc_id, vector); how they meet is told at
    :func:`tracewright.operators.vectors.cell_search`, which takes the ``options``.
    """
    return cell_search(queries, corpus, k, **options)[0]


def best_chunk_per_report(hits: DataFrame, *, reports: int = REPORT_K) -> DataFrame:
    """Best chunk per report, then the best reports per query.

    ``hits`` is (query_id, doc_id, score, report_key); a blank key stands for
    the chunk itself.
    """
    keyed = hits.withColumn("_report", F.coalesce(nonblank("report_key"), F.col("doc_id").cast("string")))
    best = keyed.groupBy("query_id", "_report").agg(
        F.max_by(F.struct("doc_id", "score"), F.struct(F.col("score"), -F.col("doc_id"))).alias("h")
    )
    flat = best.select("query_id", F.col("_report").alias("report"), "h.doc_id", "h.score")
    return top_n(flat, ["query_id"], [F.desc("score"), F.asc("doc_id")], reports, "rank")


def rerank_score(
    question: Column, score: Column, text: Column, phase: Column, heading: Column | None = None, case: Column | None = None
) -> Column:
    """Score with the bonus the question calls for.

    A question about network devices rewards device terms in text, heading, phase
    and case together; one about the time before impact rewards phases; else the
    score stands.
    """
    asked = F.lower(question)
    parts = [text, phase, *(c for c in (heading, case) if c is not None)]
    searchable = F.lower(F.concat_ws(" ", *parts))
    matches = F.size(
        F.filter(F.array(*[F.lit(t) for t in DEVICE_TERMS]), lambda t: F.contains(searchable, t))
    )
    device = score + F.least(matches * F.lit(DEVICE_STEP), F.lit(DEVICE_CAP))
    staged = score + lookup(PHASE_BONUS, F.lower(F.coalesce(phase, F.lit(""))), 0.0)
    return (
        F.when(contains_any(asked, DEVICE_SIGNALS), device)
        .when(contains_any(asked, PRE_IMPACT_SIGNALS), staged)
        .otherwise(score)
    )


def select_context(ranked: DataFrame, *, size: int = CONTEXT_K, min_chars: int = MIN_CONTEXT_CHARS) -> DataFrame:
    """First distinct (case, phase, window) chunks per query that are long enough.

    ``ranked`` carries query_id, position, case, phase, window_order and text.
    A short chunk still blocks its key.
    """
    rows = ranked.filter(clean("text") != "")
    firsts = rows.groupBy("query_id", "case", "phase", "window_order").agg(
        F.min_by(F.struct("position", "doc_id", "text", "score"), "position").alias("c")
    )
    long_enough = firsts.select("query_id", "case", "phase", "window_order", "c.*").filter(
        F.length(clean("text")) >= min_chars
    )
    return top_n(long_enough, ["query_id"], [F.asc("position")], size, "context_rank")


def retrieve_context(
    questions: DataFrame,
    chunks: DataFrame,
    *,
    pool: int = RERANK_POOL,
    keep: int = RERANK_K,
    size: int = CONTEXT_K,
    min_chars: int = MIN_CONTEXT_CHARS,
) -> DataFrame:
    """(query_id, doc_id, text, score, context_rank): search, rerank and context selection in one.

    ``questions`` is (query_id, question, vector), ``chunks`` is (doc_id, vector,
    text, heading, phase, case, window_order). Vector search gives ``pool`` chunks
    per question, of which the ``keep`` best by reranked score, ties by id, are
    looked through for context.
    """
    hits = vector_topk(questions.select("query_id", "vector"), chunks.select("doc_id", "vector"), pool)
    described = hits.join(questions.select("query_id", "question"), "query_id").join(chunks.drop("vector"), "doc_id")
    bonus = rerank_score(*map(F.col, ("question", "score", "text", "phase", "heading", "case")))
    scored = described.withColumn("score", F.round(bonus, 6))
    ranked = top_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], keep, "position")
    return select_context(ranked, size=size, min_chars=min_chars)


def grounding_violations(answer: Column, question: Column) -> Column:
    """Banned terms used before the historical section, or the missing section."""
    low, asked = F.lower(answer), F.lower(question)
    first, second = (F.instr(low, m) for m in HISTORY_MARKERS)
    at = F.when(first > 0, first).otherwise(second)
    before = F.substring(low, F.lit(1), at - 1)
    used = F.filter(
        F.array(*[F.lit(t) for t in HISTORICAL_TERMS]),
        lambda t: ~F.contains(asked, t) & F.contains(before, t),
    )
    return F.when(at == 0, F.array(F.lit("Historical Examples section not found"))).otherwise(used)


def candidate_findings(findings: DataFrame, signature: list[str]) -> DataFrame:
    """Findings worth a search: severe, unresolved, unassessed, or the first
    MEDIUM review item per signature."""
    severity, state = F.upper("severity"), F.upper("state")
    always = severity.isin("CRITICAL", "HIGH", "UNASSESSED") | state.isin("SUSPICIOUS", "AMBIGUOUS", "ESCALATED")
    review = ~always & (severity == "MEDIUM") & (state == "REVIEW_REQUIRED")
    firsts = findings.filter(review).groupBy(*signature).agg(
        F.min_by("finding_id", F.struct(-F.col("evidence_count"), F.col("finding_id"))).alias("finding_id")
    )
    return findings.filter(always).select("finding_id").unionByName(firsts.select("finding_id"))


def search_query(title: Column, finding_type: Column, summary: Column, lists: dict[str, Column]) -> Column:
    """Search text of a finding: labelled parts, eight values per list."""
    parts = [nonblank(title), F.concat(F.lit("finding type: "), nonblank(finding_type)), nonblank(summary)]
    for label, values in lists.items():
        kept = F.slice(dedupe_ci(values), 1, LIST_VALUES)
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(kept, ", "))))
    return F.left(F.concat_ws(" | ", *parts), F.lit(QUERY_CHARS))


def finding_search_queries(findings: DataFrame, values: DataFrame) -> DataFrame:
    """(finding_id, query): the first eight values per kind are ranked before
    they are gathered, so a finding with very many values stays small."""
    kinds = {"RULE": "detections", "EXECUTABLE": "executables", "PATH": "paths"}
    listed = values.filter(F.col("kind").isin(list(kinds))).groupBy("finding_id", "kind", F.lower("value").alias("_k")).agg(
        F.min("value").alias("value")
    )
    first = top_n(listed, ["finding_id", "kind"], [F.asc("value")], LIST_VALUES)
    wide = first.groupBy("finding_id").pivot("kind", list(kinds)).agg(F.array_sort(F.collect_list("value")))
    lists = {label: F.col(kind) for kind, label in kinds.items()}
    lists["evidence"] = F.col("evidence_families")
    lists["source tools"] = F.col("source_tools")
    lists["supporting evidence families"] = F.col("evidence_families")
    return findings.join(wide, "finding_id", "left").select(
        "finding_id",
        search_query(F.col("title"), F.col("finding_type"), F.col("summary"), lists).alias("query"),
    )


