"""Secret scans: assignment, access-key and hexadecimal patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_schema, map_arrow, rows_of

# The base patterns, in the order that breaks ties of their spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
IDENTIFIER = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.A | re.I)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+", re.A)
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
NUMBER = re.compile(r"[0-9_+/=-]+")
RATIO = 2.0  # characters per token below which a string counts as random
PART = 256  # characters of a candidate encoded at a time


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Strings with few characters per token: digests, identifiers and numbers excluded."""
    out = []
    for m in CANDIDATE.finditer(text):
        found = m[0]
        known = IDENTIFIER.fullmatch(found) or NUMBER.fullmatch(found) or (
            len(found) in DIGEST_LENGTHS and DIGEST.fullmatch(found)
        )
        if known:
            continue
        tokens = sum(len(encode(found[i : i + PART])) for i in range(0, len(found), PART))
        if len(found) < ratio * tokens:
            out.append((m.start(), 3, m.end()))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, ratio: float = RATIO
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_spans string, spans string) per row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, comma-joined, by
    start, then kind. A random string inside a base span adds no span of its
    own. Null text counts as empty; repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    target = arrow_schema(schema)

    def one(text: str | None, encode) -> list:
        base = base_spans(text or "")
        covered = [(s, e) for s, _, e in base]
        added = [x for x in random_spans(text or "", encode, ratio) if not any(s <= x[0] and x[2] <= e for s, e in covered)]
        numbers = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        return [*numbers, len(added), _joined(base), _joined(sorted(base + added))]

    def run(batches):
        encode = _encoding(path).encode_ordinary
        for names, texts in rows_of(batches):
            columns = [names, *map(list, zip(*(one(t, encode) for t in texts), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)
