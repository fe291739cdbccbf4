import base64
import hashlib
import random
import re

from helpers import documents
from pyspark.sql import functions as F

from tracewright.llm import secrets
from tracewright.llm.secrets import _encoding, default_vocabulary


def spans(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
                         r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(out)


def joined(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)


def test_base_spans_by_definition():
    rng = random.Random(1)
    parts = ["password", "PassWD", "secret", "token: ", "api_key=", "apikey", "paſſword", "toKen", '"', "'", " ", "=", ":", "AKIA", "ABCD1234", "abcdef", "0123456789",
             "deadbeef", "é", "\n", "x", "AAAAAAAAAAAAAA", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == spans(text), text


def test_random_strings_and_exclusions():
    encode = _encoding(default_vocabulary()).encode_ordinary
    rng = random.Random(2)
    noise = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)]
    found = [bool(secrets.random_spans(f"key {n} end", encode)) for n in noise]
    assert sum(found) >= 190
    calm = [
        "internationalization", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", hashlib.sha256(b"a").hexdigest(), hashlib.md5(b"a").hexdigest().upper(),
        "12345678901234567890123", "https://example.com/some/path/to/the/page-of-2024", "snake_case_variable_name_number_1",
    ]
    assert not any(secrets.random_spans(f"see {c} there", encode) for c in calm)
    text = f"é🙂 {noise[0]} tail"
    assert secrets.random_spans(text, encode) == [(3, 3, 3 + len(noise[0]))]


def test_edges(spark):
    secret = "token = 'abcdefghijkl'"
    texts = [None, "", secret, "AKIA" + "A" * 14, "f" * 16, secret + " " + "0" * 16, "z" * 100_000]
    docs = documents(spark, texts).withColumn("spans", F.lit("clash")).withColumn("n_hex", F.lit("x"))
    docs = docs.unionByName(docs)
    got = secrets.scan(docs).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r.base_spans == joined(spans(texts[r.doc_id]))
        assert set(r.base_spans.split(",")) <= set(r.spans.split(","))
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got}[5] == (1, 0, 1)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_query_on_table(spark):
    from tracewright.llm.queries import op8_secrets

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in op8_secrets(spark, "/root/testdata/sf0.01").collect():
        found = spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in found) for kind in range(3))
