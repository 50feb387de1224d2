"""Benchmark decontamination with a generalised suffix automaton.

Items are lower-cased (A-Z) and cut into words of digits, letters a-z and characters beyond ASCII.
One automaton holds all items of a block; a document's words are streamed through it, which gives
the longest match that ends at each word. Every ``window`` words in a row of an item, and the whole
of a shorter item, is a window; words inside an occurrence of a window are hit. Runs of hit words
are spans; ``clean`` removes spans, and documents that are mostly hit.

The benchmark may be of any size: it is cut into blocks of at most ``BLOCK_WORDS`` words, each block
is one automaton of a bounded size that is sent to the workers, and the documents pass all blocks in
one chain without a shuffle.

Odd input: a null text has no words, a null item or one without words has no window and is never
found, repeated items count once for each item id. Repeated rows and other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

WINDOW = 10
#: Words of the items in one automaton, which has at most twice as many states.
BLOCK_WORDS = 500_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state -> items with a full window that ends there; state -> (words, items) of short items.
        self.full: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        for name, seq in coded:
            for _, state, matched in self._walk(seq):
                if matched >= window:
                    self.full.setdefault(self._suffix(state, window), set()).add(name)
            if len(seq) < window:
                state = 0
                for c in seq:
                    state = self.next[state][c]
                own.setdefault(state, {}).setdefault(len(seq), set()).add(name)
        #: Short items that end at a state or at a suffix of it.
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        if own:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                found = [*own.get(state, {}).items(), *self.short.get(self.link[state], [])]
                if found:
                    self.short[state] = found
        self.least = min((min(len(seq), window) for _, seq in coded), default=0)

    def _extend(self, last: int, c: int) -> int:
        following, link, length = self.next, self.link, self.length
        if c in following[last]:
            q = following[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = following[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _suffix(self, state: int, words_: int) -> int:
        """The state of the last ``words_`` words of what ``state`` has matched."""
        while self.length[self.link[state]] >= words_:
            state = self.link[state]
        return state

    def _walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest match that ends at each word."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, c in enumerate(seq):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c in following[state]:
                state = following[state][c]
                matched += 1
            yield i, state, matched

    def find(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of word positions (end excluded, not merged), and the items found."""
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        n = len(doc)
        if n < self.least or not self.least:
            return ranges, found
        codes = np.fromiter(map(self.ids.get, doc, [-1] * n), dtype=np.int64, count=n)
        # A word outside the items' vocabulary matches nothing: only runs without one are streamed.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], codes >= 0, [0]]).astype(np.int8)))
        window, full, short = self.window, self.full, self.short
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.least:
                continue
            for i, state, matched in self._walk(codes[a:b].tolist()):
                end = a + i + 1
                if matched >= window:
                    ranges.append((end - window, end))
                    found |= full[self._suffix(state, window)]
                if short:
                    for size, names in short.get(state, ()):
                        if size <= matched:
                            ranges.append((end - size, end))
                            found |= names
        return ranges, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as ranges that do not touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_BUILT: dict[tuple[str, int], Automaton] = {}
C.worker_table(_BUILT.clear)


def _automaton(items: Broadcast, window: int) -> Automaton:
    """Built once per worker; only the block in use and the one before stay."""
    name, block = items.value
    key = (name, window)
    if key not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Automaton(block, window)
    return _BUILT[key]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """The items in blocks of at most ``block_words`` words (an item is never cut)."""
    context = benchmark.sparkSession.sparkContext
    out, block, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), C.utf8(text_col).alias("text")).where("id IS NOT NULL")
    # One partition of the items is in the driver at a time, and of it one block.
    for row in rows.toLocalIterator():
        ws = words(bytes(row.text))
        if not ws:
            continue
        if block and size + len(ws) > block_words:
            out.append(context.broadcast((C.fresh_name(), block)))
            block, size = [], 0
        block.append((row.id, ws))
        size += len(ws)
    if block or not out:
        out.append(context.broadcast((C.fresh_name(), block)))
    return out


_FIELDS = "n_words long, spans array<int>, items array<string>"


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Adds n_words, spans (word positions: start, end, start, end ...; ends excluded) and items (sorted)."""
    C.prepare(docs.sparkSession)
    parts = blocks(benchmark, item_id_col, item_text_col, block_words)
    names = docs.columns if keep is None else keep
    out = docs
    for k, items in enumerate(parts):
        kept = names if k == len(parts) - 1 else list(dict.fromkeys([*names, text_col]))
        out = C.map_texts(out, text_col, _finder(items, window), _FIELDS, kept, ["spans", "items"] if k else [])
    return out


def _finder(items: Broadcast, window: int):
    def find(texts: list[bytes], *before: pa.Array) -> list[pa.Array]:
        automaton = _automaton(items, window)
        n_words, spans, names = [], [], []
        earlier = zip(before[0].to_pylist(), before[1].to_pylist()) if before else iter(lambda: ([], []), None)
        for text, (old, known) in zip(texts, earlier):
            ws = words(text)
            ranges, found = automaton.find(ws)
            n_words.append(len(ws))
            spans.append([x for r in merged([*ranges, *zip(old[::2], old[1::2])]) for x in r])
            names.append(sorted(found.union(known)))
        return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]

    return find


def hit_words():
    """Column: hit words of a row of ``find_hits``."""
    ends = F.expr("aggregate(spans, struct(0L AS total, 0L AS sign), (a, x) -> struct(IF(a.sign = 1, a.total + x, a.total - x) AS total, 1L - a.sign AS sign), a -> a.total)")
    return ends


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    **names: str,
) -> DataFrame:
    """Documents without hit spans: all spans are cut out of the text, those of whole short items as
    well, and documents of which more than ``max_coverage`` of the words are hit go whole. Columns
    stay as they are but for the text.
    """
    # Clashes cannot come up: the input travels as one struct.
    row = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    hits = find_hits(row, benchmark, "_text", window, **names)
    left = hits.where(hit_words() <= max_coverage * F.col("n_words"))

    def cut(texts: list[bytes], spans: pa.Array) -> list[pa.Array]:
        out = []
        for text, at in zip(texts, spans.to_pylist()):
            if at:
                where = [m.span() for m in _WORD.finditer(text.lower())]
                pieces, start = [], 0
                for a, b in zip(at[::2], at[1::2]):
                    pieces.append(text[start : where[a][0]])
                    start = where[b - 1][1]
                text = b"".join([*pieces, text[start:]])
            out.append(text)
        return [pa.array(out, pa.binary()).cast(pa.string())]

    done = C.map_texts(left, "_text", cut, "_clean string", ["_row", "_text"], ["spans"])
    changed = F.when(F.col("_text").isNotNull(), F.col("_clean"))
    return done.select(*[changed.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
