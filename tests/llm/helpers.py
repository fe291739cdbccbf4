"""Small tables for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.select(*columns).collect()], key=repr)
