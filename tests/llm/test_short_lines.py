import random

from helpers import documents, rows
from test_linededup import corpus, plain

from tracewright.llm import linededup


def copies(texts):
    """Lines with the words of an earlier line, each as often."""
    seen, found = set(), set()
    for d, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = tuple(sorted(line.lower().split()))
            if words:
                (found.add((d, k)) if words in seen else seen.add(words))
    return found


def test_exact_copies_of_short_lines(spark):
    texts = [*corpus(8, 120), "Share\n\nkeep this", " share \n\nkeep that", "share share\n ", "read more now"]
    short = copies(texts) - plain(texts, least=5)
    assert len(short) > 10
    got = rows(linededup.duplicate_lines(documents(spark, texts), least_words=5, copied_words=1), "doc", "line")
    assert set(got) == plain(texts, least=5) | copies(texts) and len(got) == len(set(got))
    assert set(rows(linededup.duplicate_lines(documents(spark, texts)), "doc", "line")) == plain(texts) > copies(texts)


def test_scripts_without_blanks(spark):
    rng = random.Random(2)
    han = "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(60))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(60))
    other = "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(60))
    texts = [f"{han}\n{thai}", other, f"{han[:30]}x{han[31:]}\n{thai[:-2]}", han[::-1], "é" * 30, "é" * 30 + "è"]
    assert set(rows(linededup.duplicate_lines(documents(spark, texts)), "doc", "line")) == {(2, 0), (2, 1)}
    assert linededup.spaced("a中文字b 仮\nñ".encode()).decode().split() == ["a", "中文", "文字", "b", "仮", "ñ"]


def test_query_takes_short_copies(spark):
    from tracewright.llm.queries import op5_lines

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = [docs[i] for i in range(len(docs))]
    gone = plain(texts)
    assert gone > copies(texts)
    for r in op5_lines(spark, sf).collect():
        kept = [x for k, x in enumerate(docs[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        assert (r.text, r.n_removed) == ("\n".join(kept), docs[r.doc_id].count("\n") + 1 - len(kept))
