import random
import zlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import packing


def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def test_ids_equal_the_tokenizer(monkeypatch):
    rng = random.Random(7)
    alphabet = list("abcdeXYZ019 '  \n\t.,-_%&") + ["é", "ß", "½", "²", "中", "\x1c", "\x85", "\xa0", "ª", "٣", "’", "🙂", "'s", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet[: rng.choice([24, 26, 50])]) for _ in range(rng.randint(0, 300))) for _ in range(600)]
    encode, t = packing.Encoder(packing.default_vocabulary()), tokenizer()
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode.encode(texts)] == want
    monkeypatch.setattr(packing, "CHUNK", 20)
    assert [np.frombuffer(b, "<u4").tolist() for b in encode.encode(texts)] == want
    plain = packing.Encoder(packing.default_vocabulary())
    plain.single = None
    assert plain.encode(texts) == encode.encode(texts)
    monkeypatch.setattr(packing, "CACHED", 50)
    assert [np.frombuffer(b, "<u4").tolist() for b in encode.encode(texts[:50])] == want[:50]


def test_added_tokens_have_their_own_ids():
    ids = np.frombuffer(packing.Encoder(packing.default_vocabulary()).encode(["a <|endoftext|> b"])[0], "<u4").tolist()
    assert ids == [64, 220, 50256, 275] == tokenizer().encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_words_by_ranks_equal_the_tokenizer():
    """Every kind of word that the plain pattern gives, by both libraries."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéèàçüößñíóúâêîôûœøåÆŁšž"
    words = {rng.choice(["", " "]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(20000)}
    words |= {rng.choice(["", " "]) + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 30))) for _ in range(3000)}
    words |= {rng.choice(["", " "]) + "".join(rng.choice("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~¡«»¿×÷") for _ in range(rng.randint(1, 12))) for _ in range(3000)}
    words |= {"".join(rng.choice(" \n\t\r\xa0") for _ in range(rng.randint(1, 12))) for _ in range(500)}
    words = sorted(words)
    by_ranks, t = packing.Encoder(packing.default_vocabulary()).single, tokenizer()
    assert [by_ranks(w) for w in words] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def check(rows, ids_of, size):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        ids = np.array(ids_of[doc] + [0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.length == size for r in parts[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
    return len(by_sequence)


def test_sum_of_squares_places_by_definition():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 200)
    got = packing.sum_of_squares(lengths, 20)
    gaps, want = {}, []
    for i, s in enumerate(lengths.tolist()):
        counts = [0] * 21
        for g in gaps.values():
            counts[g] += 1

        def cost(g):
            after = counts[:]
            if g < 20:
                after[g] -= 1
            after[g - s] += 1
            return sum(n * n for n in after[1:20])

        options = [(cost(g), g) for g in range(s, 21) if g == 20 or counts[g]]
        _, gap = min(options)
        if gap == 20:
            number = len(want)
            want.append([i])
        else:
            number = max((n for n, g in gaps.items() if g == gap), key=lambda n: want[n][-1])
            want[number].append(i)
        gaps[number] = gap - s
    assert sorted(map(len, got)) == sorted(map(len, want)) and len(got) == len(want)


def test_few_sequences_over_many_shards(spark):
    rng = random.Random(11)
    lengths = [min(2048, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(4000)]
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for shard_rows in (4000, 100):
        got = packing.pack_pieces(parts, shard_rows=shard_rows).collect()
        used = {}
        for r in got:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(got) == 4000 and all(sum(n for _, n in p) <= 2048 for p in used.values())
        assert len(used) <= 1.01 * sum(lengths) / 2048 + 2


def test_edges(spark):
    texts = [None, "", "a", "word " * 5000, "x\ny", "<|endoftext|>", "a"]
    docs = documents(spark, texts).withColumn("piece", F.lit("clash")).withColumn("offset", F.lit(1))
    t = tokenizer()
    ids_of = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    check(packing.best_fit_pack(docs).collect(), ids_of, 2048)
    assert packing.best_fit_pack(docs.limit(0)).count() == 0
    twice = packing.best_fit_pack(docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(twice) == 2 * (len(texts) + 2)
    ids = {tuple(r.ids) for r in packing.sequences(docs, packing.best_fit_pack(docs)).collect()}
    assert sum(map(len, ids)) == sum(len(v) + 1 for v in ids_of.values())


def test_query_on_table(spark):
    from tracewright.llm.queries import op10_pack

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    t = tokenizer()
    ids_of = {d.doc_id: e.ids for d, e in zip(docs, t.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True)}
    used = check(op10_pack(spark, sf).collect(), ids_of, 2048)
    assert used <= 1.02 * sum(len(v) + 1 for v in ids_of.values()) / 2048 + 1


def test_other_tasks_release_the_encoder():
    """A Python worker that goes on with other steps does not keep the words of its packing tasks."""
    from tracewright.llm import common, packing

    packing.encoder(packing.default_vocabulary()).encode(["some words that are kept"])
    assert packing.encoder.cache_info().currsize
    common.release_encoder()
    assert not packing.encoder.cache_info().currsize
