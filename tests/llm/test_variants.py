import random
import zlib
from collections import Counter

from helpers import documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import variants
from tracewright.llm.queries import QUERIES

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def is_letter(c):
    return c.isascii() and c.isalpha() or "À" <= c <= "ÿ"


def plain_runs(text):
    out, now = [], ""
    for c in text + " ":
        if is_letter(c):
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out


def plain_vocabulary(docs, every, least_length, least_count):
    n = Counter()
    for name, text in docs:
        for run in plain_runs(text or ""):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_rows(n, ratio=5):
    near, form = {}, {}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@given(st.text(alphabet="aBÀÿ×é1 'Łß", max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_runs(text, chunk):
    old = variants.CHUNK
    variants.CHUNK = chunk
    try:
        assert variants.runs(text) == Counter(plain_runs(text))
    finally:
        variants.CHUNK = old


def test_near_words_of_a_small_alphabet(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice((1, 2, 2, 7, 40, 41, 500)) for _ in range(700)}
    found = variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long"))
    want = []
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want.append((w, len(near), best, words[best]))
    assert rows(found, "word", "n_near", "near", "near_n") == sorted(want, key=repr)


def test_groups_across_batches(spark):
    words = {a + "xyz" + b: i for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = rows(variants.near_words(frame), "word", "n_near", "near")
    old = variants.HELD_ROWS
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        variants.HELD_ROWS = 4
        made = list(variants._scanned(iter(variants.rotations(frame).orderBy("key").toArrow().to_batches(max_chunksize=3)), variants.arrow_schema("word string, near long, best string, best_n long")))
    finally:
        variants.HELD_ROWS = old
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sum(n for b in made for n in b.column(1).to_pylist()) == sum(n for _, n, _ in want) == 100 * 18


def test_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "b")]
    found = variants.last_of_chain(spark.createDataFrame(links, "word string, form string"))
    assert rows(found, "word", "root") == sorted([(f"w{i}", "w13") for i in range(13)] + [("a", "b")], key=repr)
    assert variants.last_of_chain(spark.createDataFrame([], "word string, form string")).count() == 0


def test_rows_against_plain_version(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 8))) for _ in range(60)]

    def word():
        w = base[min(int(rng.expovariate(0.1)), 59)]
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abX") + w[i + 1 :], w[:i] + rng.choice("abX") + w[i:]))
        return w

    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(120)] + [None, "", "12 34", "Aa" * 3000 + " x"]
    texts += [" ".join(["qqqqqq"] * 130 + ["qqqqqr"] * 26 + ["qqqqrr"] * 5)]  # a chain of two forms
    docs = documents(spark, texts).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    nameless = docs.limit(9).withColumn("doc_id", F.lit(None).cast("long"))
    pairs = [*enumerate(texts), *((None, r.text) for r in nameless.collect())]
    for every in (None, 7):
        want = plain_rows(plain_vocabulary(pairs, every, 6, 5))
        assert any(r[1] for r in want) and (every or any(r[2] not in (r[0], r[1]) for r in want))
        assert rows(variants.spelling_variants(docs.unionByName(nameless), slip_every=every), *COLUMNS) == want
    nothing = variants.spelling_variants(docs.limit(0))
    assert nothing.columns == list(COLUMNS) and nothing.count() == 0


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_variants"](spark, sf), *COLUMNS) == plain_rows(plain_vocabulary(docs, 199, 6, 5))
