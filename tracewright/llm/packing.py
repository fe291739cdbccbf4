"""Sum-of-squares packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import CHUNK, arrow_schema, map_arrow, rows_of, ship_package
from tracewright.session import cut_lineage

SIZE = 2048  # tokens of a sequence
END = 0  # id after every document
SHARD_ROWS = 50_000  # pieces packed by one task
FAN_IN = 16  # shards whose open sequences meet in the next round
HANDED_ON = 4096  # pieces of open sequences that a shard hands on
CACHED = 600_000  # words whose ids a worker keeps
SHORT = 10  # characters of a word that stays when the others are dropped

# Word pattern of the byte-level vocabulary, for texts in which it means the same to Python's re as to the
# tokenizer: printable ASCII, Latin letters and the usual white space. Other texts go to the tokenizer whole.
PLAIN_WORDS = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
CUT = re.compile(r"(?<=\S)(?=\s)")


def _word_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of the vocabulary's own added tokens have their ids wherever they stand, so no words are cut out of such texts.
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known: dict[str, bytes] = {}
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.single = _word_encoder(ranks) if os.path.exists(ranks) else None

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of single words; the same vocabulary written as ranks gives them faster, where its file is there."""
        if self.single is not None:
            found = map(self.single, words)
        else:
            found = (e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
        self.known.update(zip(words, (pack(f"<{len(ids)}I", *ids) for ids in found), strict=True))

    def _chunks(self, text: str):
        """Parts of about CHUNK characters, cut where white space begins, which no word crosses."""
        start = 0
        while start < len(text):
            cut = CUT.search(text, start + CHUNK) if start + CHUNK < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; words that were not met before are encoded together."""
        if len(self.known) > CACHED:
            # Short words come again most.
            self.known = {word: ids for word, ids in self.known.items() if len(word) <= SHORT}
            if len(self.known) > CACHED // 2:
                self.known = {}
        out, open_words = [], {}
        for text in texts:
            if len(text) > CHUNK or NOT_PLAIN.search(text) or self.added.search(text):
                out.append([self._direct([c])[0] for c in self._chunks(text)])
                continue
            words = PLAIN_WORDS.findall(text)
            parts = list(map(self.known.get, words))
            for i, part in enumerate(parts):
                if part is None:
                    open_words.setdefault(words[i], []).append((parts, i))
            out.append(parts)
        self._learn(list(open_words))
        for word, places in open_words.items():
            part = self.known[word]
            for parts, i in places:
                parts[i] = part
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first piece takes the remainder."""
    first = n % size or min(n, size)
    return [(0, first)] + [(start, size) for start in range(first, n, size)]


def pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's ids followed by END.

    Null text counts as empty: one piece of one id. Repeated rows give repeated pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    target = arrow_schema(schema)

    def run(batches):
        encode, end = encoder(vocabulary).encode, np.array([END], "<u4").tobytes()
        for names, texts in rows_of(batches):
            out = [[] for _ in target]
            for name, ids in zip(names, encode([t or "" for t in texts]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [name, k, start, length, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, "<i4"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return map_arrow(docs.select(id_col, text_col), run, schema, encodes=True)


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Sequences (lists of indexes into ``lengths``), each piece put where the sum of squares gets smallest.

    The sum runs over the residual gaps 1 to size - 1 of the squared number of
    open sequences with that gap. Full sequences leave it, so a perfect fit
    always lowers it most for its gap. Ties go to the smallest gap.
    """
    count = np.zeros(size + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(size + 1)]
    out: list[list[int]] = []
    never = np.int64(1) << 60
    for index, s in enumerate(lengths.tolist()):
        here = count[s:size]
        change = 2 * (count[: size - s] - here) + 2
        if s < size:
            change[0] -= 1
            change[here == 0] = never
            k = int(change.argmin())
        if s < size and change[k] <= 2 * count[size - s] + 1:
            gap = s + k
            sequence = held[gap].pop()
            count[gap] -= 1
            out[sequence].append(index)
        else:
            gap, sequence = size, len(out)
            out.append([index])
        gap -= s
        if gap:
            count[gap] += 1
            held[gap].append(sequence)
    return out


def pack_lengths(lengths: np.ndarray, size: int = SIZE, rounds: int = 4) -> list[list[int]]:
    """Fewest sequences found: sum of squares over several orders, open sequences taken apart and placed again."""
    ordered = np.argsort(-lengths, kind="stable")

    def best(index: np.ndarray) -> list[list[int]]:
        mixed = np.random.default_rng(len(index)).permutation(index)
        found = [[order[np.array(b)] for b in sum_of_squares(lengths[order], size)] for order in (index, mixed)]
        return min(found, key=len)

    current = best(ordered)
    for _ in range(rounds):
        full = [b for b in current if lengths[b].sum() == size]
        rest = [b for b in current if lengths[b].sum() < size]
        if len(rest) < 2:
            break
        index = np.concatenate(rest)
        again = best(index[np.argsort(-lengths[index], kind="stable")])
        if len(again) > len(rest):
            break
        current = full + again
    return [list(map(int, b)) for b in current]


def _shard_packer(level: int, last: bool, size: int):
    return lambda rows: _pack_shard(rows, level, last, size)


def _pack_shard(rows: pd.DataFrame, level: int, last: bool, size: int) -> pd.DataFrame:
    """One shard's sequences; rows of open ones handed on have no sequence."""
    lengths = rows["length"].to_numpy()
    sequences = pack_lengths(lengths, size)
    sequence, offset = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
    gaps = [size - int(lengths[b].sum()) for b in sequences]
    handed = 0
    base = (level << 56) | (int(rows["shard"].iloc[0]) << 24)
    for number in np.argsort(-np.array(gaps), kind="stable"):
        b = sequences[number]
        if not last and gaps[number] and handed + len(b) <= HANDED_ON:
            handed += len(b)
            continue
        sequence[b] = base | int(number)
        offset[b] = np.r_[0, np.cumsum(lengths[b])[:-1]]
    return rows.assign(sequence_id=sequence, offset=offset)


def pack_pieces(parts: DataFrame, size: int = SIZE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``parts`` with sequence_id and offset: every piece in one sequence of at most ``size`` ids, gapless.

    Whole-length pieces are sequences of their own. The others are dealt to
    shards of ``shard_rows`` rows, whatever their document; each shard packs
    its rows and hands on the pieces of its emptiest sequences (at most
    HANDED_ON rows), which meet those of FAN_IN shards in the next round, until
    one shard is left. Every task's rows are bounded at any input size.
    """
    ship_package(parts.sparkSession)
    columns = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    whole = parts.filter(F.col("length") >= size).select(
        *columns, (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = parts.filter(F.col("length") < size)
    shards = max(1, -(-rest.count() // shard_rows))
    rest = rest.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("long"))
    done, level = [whole], 0
    while True:
        last = shards == 1
        packed = rest.groupBy("shard").applyInPandas(
            _shard_packer(level, last, size), f"{schema}, shard long, sequence_id long, offset long"
        )
        if last:
            return _union([*done, packed.drop("shard")])
        packed = cut_lineage(packed)
        done.append(packed.filter("sequence_id >= 0").drop("shard"))
        shards = -(-shards // FAN_IN)
        rest = packed.filter("sequence_id < 0").select(*columns, F.floor(F.col("shard") / FAN_IN).cast("long").alias("shard"))
        level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def best_fit_pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    vocabulary: str | None = None,
    size: int = SIZE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``.

    A document is its ids and END; only documents over ``size`` ids are cut.
    Null text is empty (END alone), ids may be null or repeat, other columns are
    ignored, and an empty table gives no rows. Sequence ids are arbitrary longs.
    """
    parts = cut_lineage(pieces(docs, vocabulary or default_vocabulary(), id_col, text_col, size))
    return pack_pieces(parts, size, shard_rows)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """(sequence_id, ids) of packed documents with distinct ids; a sequence has at most ``size`` ids."""
    parts = pieces(docs, vocabulary or default_vocabulary(), id_col, text_col, size, with_ids=True)
    placed = parts.select(id_col, "piece", "ids").join(packed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    listed = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return listed.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
