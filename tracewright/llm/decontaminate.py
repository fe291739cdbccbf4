"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import with_results

WINDOW = 10  # words of a window
COVERAGE = 0.8  # a document with at least this share of hit words goes whole
SHARD_WORDS = 2_000_000  # item words of one automaton

# Every ASCII byte but digits and letters separates words; A-Z are lower-cased; other bytes belong to words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class SuffixAutomaton:
    """All word runs of several items: longest match at each position of a text, and the items that hold it.

    States and transitions grow linearly with the item words. Item sets are
    kept only for the states that stand for a whole window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}  # state -> whole items (words, id) that end there
        self.least = window
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, words in coded:
            state = 0
            for word in words:
                state = self._extend(state, word)
        for name, words in coded:
            state, length = 0, 0
            for i, word in enumerate(words):
                state, length = self.step(state, length, word)
                if i + 1 >= window:
                    self.items.setdefault(self.of_length(state, window), set()).add(name)
            if 0 < len(words) < window:
                self.short.setdefault(state, set()).add((len(words), name))
                self.least = min(self.least, len(words))

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        """Online extension; items start again at the root, so existing transitions are reused."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            fits = self.length[target] == self.length[last] + 1
            self.link[state] = target if fits else self._split(last, word, target)
        return state

    def _split(self, last: int, word: int, target: int) -> int:
        copy = self._new(self.length[last] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while last >= 0 and self.next[last].get(word) == target:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and longest matching length after one more text word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        following = self.next[state].get(word)
        return (0, 0) if following is None else (following, length + 1)

    def of_length(self, state: int, length: int) -> int:
        """The state of the last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """(marks of hit words or None, ids of items with a window in ``words``)."""
        find = self.vocabulary.get
        codes = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        inside = np.flatnonzero(np.diff(np.r_[0, codes >= 0, 0].astype(np.int8)))
        starts, ends = inside[::2], inside[1::2]
        marks, found = None, set()
        # A word that no item has ends every match, so only runs of known words can hold a window.
        for k in np.flatnonzero(ends - starts >= self.least):
            state = length = 0
            for at, word in enumerate(codes[starts[k] : ends[k]].tolist(), int(starts[k]) + 1):
                state, length = self.step(state, length, word)
                reach = 0
                if length >= self.window:
                    reach = self.window
                    found |= self.items[self.of_length(state, self.window)]
                if self.short and length >= self.least:
                    up = state
                    while up > 0:
                        for size, name in self.short.get(up, ()):
                            if size <= length:
                                found.add(name)
                                reach = max(reach, size)
                        up = self.link[up]
                if reach:
                    marks = np.zeros(len(words), bool) if marks is None else marks
                    marks[at - reach : at] = True
        return marks, found


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> list[SuffixAutomaton]:
    """Automata of at most ``shard_words`` item words each (one item at least), so none outgrows a task."""
    out, held, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    for name, text in rows.toLocalIterator():
        words = item_words(bytes(text) if text is not None else None)
        if not words:
            continue
        if held and size + len(words) > shard_words:
            out.append(SuffixAutomaton(held, window))
            held, size = [], 0
        held.append((name or "", words))
        size += len(words)
    return [*out, SuffixAutomaton(held, window)] if held else out


def _spans(text: bytes, marks: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans from the first to the last word of every run of marked words."""
    kept = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, kept, 0].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.r_[0, marks, 0].astype(np.int8)))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    shard_words: int = SHARD_WORDS,
    with_text: bool = False,
    carry: bool = False,
) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, drop[, cleaned]) per row of ``docs``.

    A document word is hit if it lies in an occurrence of ``window`` consecutive
    item words (of a whole item, if that is shorter). ``items`` are the sorted
    ids of the items that occur. ``drop`` says that hit words reach the
    ``coverage`` limit or leave no word; ``cleaned`` is the text without the
    spans of hit words (null for null text). With ``carry``, all columns of
    ``docs`` and these with a leading underscore.

    Null text has no words. Items without words take no part; a null item id
    counts as an empty string. Repeated rows are scored alike. Other columns are
    ignored. The automata travel as one serialized broadcast of at most
    ``shard_words`` words each; with more items a text meets them one by one.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(a) for a in automata(benchmark, item_id_col, item_text_col, window, shard_words)]
    schema = "n_words long, n_hit long, items array<string>, drop boolean" + ", cleaned string" * with_text

    def one(given: str | bytes | None) -> list:
        text = given.encode() if isinstance(given, str) else given
        words = item_words(text)
        marks, found = None, set()
        for each in shared:
            hit, names = each.value.hits(words)
            found |= names
            if hit is not None:
                marks = hit if marks is None else marks | hit
        n_hit = 0 if marks is None else int(marks.sum())
        row = [len(words), n_hit, sorted(found), n_hit > 0 and (n_hit >= coverage * len(words))]
        if with_text:
            cleaned = text
            for a, b in reversed(_spans(text, marks)) if n_hit else ():
                cleaned = cleaned[:a] + cleaned[b:]
            row.append(None if text is None else cleaned.decode("utf-8", "replace"))
        return row

    def work(columns: list[list]) -> list[list]:
        return list(map(list, zip(*map(one, columns[0]), strict=True)))

    return with_results(docs, [text_col], schema, work, carry, [id_col])
