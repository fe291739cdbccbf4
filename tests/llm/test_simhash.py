import random

import xxhash
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import simhash


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + width] for i in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


@given(st.one_of(st.none(), st.text(alphabet="aB \n\té\x1c", max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    got = simhash.fingerprint(None if text is None else text.encode())
    assert got % (1 << 64) == plain_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdef") * rng.randint(1, 4) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    from tracewright.llm import common

    monkeypatch.setattr(simhash, "byte_words", lambda data: common.byte_words(data, 100))
    assert simhash.fingerprint(text.encode()) == whole


def near_values(rng, centres, members, flips):
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            value = centre
            for _ in range(rng.randint(0, flips)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return sorted(out)


def check_links(spark, values, **options):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), **options).collect()
    ids = dict(zip(signed, values, strict=True))
    assert all((ids[r.a] ^ ids[r.b]).bit_count() <= 4 for r in links)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        parent[root(ids[r.a])] = root(ids[r.b])
    want = plain_components(values, values, 4)
    groups = {}
    for v in values:
        groups.setdefault(root(v), []).append(v)
    assert {v: min(g) for g in groups.values() for v in g} == want
    return links


def test_links_connect_like_all_pairs(spark):
    values = near_values(random.Random(2), 20, 15, 7)
    check_links(spark, values)
    check_links(spark, values, blocks=5)


def test_hot_bucket_is_cut_again(spark):
    values = near_values(random.Random(3), 2, 120, 8)
    links = check_links(spark, values, blocks=7, bucket_rows=10)
    assert links


def test_block_count_follows_size():
    assert simhash.block_count(1000) == 7
    assert simhash.block_count(5 * 10**10) > 8


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, base, "", base + " tail", "x", "X", base.upper(), "other words here now", None]
    docs = documents(spark, texts).withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1))
    docs = docs.unionByName(docs.filter("doc_id = 4"))  # a repeated row
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_components(list(range(len(texts))), prints, 4)
    assert {r.doc_id: r.component for r in got} == want
    assert len(got) == len(texts) + 1
    assert want[8] == want[2] == 0 and want[5] == 4 and want[6] == 1


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (None, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component) for r in simhash.near_duplicates(docs).collect() if r.component)
    assert got == [(False, 7), (True, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_on_table(spark):
    from tracewright.llm.queries import op1_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    prints = [plain_fingerprint(d.text) for d in docs]
    want = plain_components([d.doc_id for d in docs], prints, 4)
    assert got == {d.doc_id: (f"{p:016x}", want[d.doc_id]) for d, p in zip(docs, prints, strict=True)}
