"""Registered queries of the corpus operators and their reference SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(bucket_of("doc_id", 3) != 1)))
    held_out = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(bucket_of("doc_id", 5) != 0)
    found = score(docs, learn(docs, labels))
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.linededup import remove_duplicate_lines

    found = remove_duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.pii import replace_entities

    found = replace_entities(table(spark, sf_dir, "documents"), key="surrogates")
    return found.select("doc_id", "text", "n_entities")


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.secrets import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


@_query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"))


@_query
def op11_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.ctph import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


@_query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.variants import SLIP_EVERY, spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), slip_every=SLIP_EVERY)


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20"""

# The windows of all items by their text; documents give their word runs of each window length that occurs.
ORACLES["op6_decontaminate"] = """
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
r AS (
  SELECT row_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS run
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g))),
m AS (SELECT row_id, item, size, k FROM r JOIN g USING (size, run)),
h AS (SELECT row_id, count(DISTINCT place) AS n FROM (SELECT row_id, unnest(range(k, k + size)) AS place FROM m) GROUP BY row_id),
n AS (SELECT row_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_id, item FROM m) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN n USING (row_id)"""

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
