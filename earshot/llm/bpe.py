"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token holds can never be inside one token, so the
text is certainly cut there. Fragments between such cuts are encoded independently, each once per
worker while its table lasts, and their ids are concatenated. Cuts of the tokenizer's own word
pattern come first, as merges never cross them either.

Odd input: a null text counts as empty and gives no ids. Texts with the string of a special token
give its id, as the tokenizer itself does. Any row count, repeated rows and other columns pass
through unchanged.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import common as C

#: Largest vocabulary file that is sent to the workers.
MAX_VOCABULARY_BYTES = 64 << 20

#: Entries of a worker's tables of encoded pieces, some 200 bytes each, together; when there are more, they
#: start anew.
CACHE_PIECES = 150_000

#: White space as the word pattern of the tokenizer knows it (fixed values of Unicode).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level word pattern (a fixed value of the public tokenizer), with its white space spelt out.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


class Uneven(Exception):
    """A text in which white space is not single."""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary -> the byte.

    Printable bytes stand for themselves; the others, in order, for the letters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        letters = byte_letters()
        to_bytes = lambda piece: bytes(letters[c] for c in piece)
        special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: dict[int, bytes] = {i: to_bytes(t) for t, i in model["vocab"].items() if t.encode() not in special}
        ids = {t: i for i, t in self.tokens.items()}
        self.tokens |= {i: t for t, i in special.items()}
        self.special = {t: np.array([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.split_special = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + b")") if special else None
        self.newline = _packed([ids[b"\n"]])
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}  # pair of ids -> rank
        self.made: list[int] = []  # by rank: the id that the pair becomes
        for rank, merge in enumerate(model["merges"]):
            a, b = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.merges[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
        never = len(self.made)
        #: At 256 * first + second byte: the rank of their merge, NEVER, or FORCED where any text is cut.
        self.never, self.forced = never, never + 1
        self.first = [self.forced] * (1 << 16)
        for t in ids:
            for x, y in zip(t, t[1:]):
                self.first[x << 8 | y] = self.merges.get((self.single[x], self.single[y]), never)
        self._spaced: dict[bytes, bytes] = {}  # packed ids of a piece after a space, without the space
        self._bare: dict[bytes, bytes] = {}  # of words that start a line
        self._fragments: dict[bytes, bytes] = {}  # of other fragments

    def fragments(self, word: bytes) -> list[tuple[bytes, list[int]]]:
        """Fragments between forced boundaries, each with the ranks of its byte pairs."""
        first = self.first
        ranks = [first[x << 8 | y] for x, y in zip(word, word[1:])]
        if self.forced not in ranks:
            return [(word, ranks)]
        at = [0, *[i for i, r in enumerate(ranks, 1) if r == self.forced], len(word)]
        return [(word[i:j], ranks[i : j - 1]) for i, j in zip(at, at[1:])]

    def merge(self, fragment: bytes, ranks: list[int]) -> list[int]:
        """Token ids of a fragment: merges by rank, the leftmost first."""
        single, made, rank_of, never = self.single, self.made, self.merges.get, self.never
        ids = [single[b] for b in fragment]
        if len(ids) > 48:
            return self._merge_long(ids)
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, in n log n."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    p = (ids[left], ids[after[left]])
                    if p in merges:
                        heapq.heappush(heap, (merges[p], left, p))
        return [t for t in ids if t >= 0]

    def _pieces(self, text: bytes) -> bytes:
        """Packed ids of any text, by the word pattern and the forced boundaries."""
        return b"".join([self._encoded(w.encode()) for w in WORDS.findall(text.decode("utf-8", "replace"))])

    def _encoded(self, word: bytes) -> bytes:
        """Packed ids of one match of the word pattern."""
        made = []
        for fragment, ranks in self.fragments(word):
            spaced = fragment[0] == 32 and len(fragment) > 1
            table, key = (self._spaced, fragment[1:]) if spaced else (self._fragments, fragment)
            made.append(table.get(key) or self._stored(table, key, _packed(self.merge(fragment, ranks))))
        return made[0] if len(made) == 1 else b"".join(made)

    def _stored(self, table: dict[bytes, bytes], key: bytes, packed: bytes) -> bytes:
        if len(self._spaced) + len(self._bare) + len(self._fragments) >= CACHE_PIECES:
            self._spaced.clear()
            self._bare.clear()
            self._fragments.clear()
        if len(key) <= 48:
            table[key] = packed
        return packed

    def _word(self, table: dict[bytes, bytes], word: bytes, space: bytes) -> bytes:
        """Packed ids of a word between single spaces and line ends, first seen here."""
        text = word.decode("utf-8", "replace")
        if not text or text[0].isspace() or text[-1].isspace():
            raise Uneven
        if text.isalpha():  # one match of the word pattern
            return self._stored(table, word, self._encoded(space + word))
        if text[-1] in ".," and text[:-1].isalpha():  # two
            return self._stored(table, word, self._encoded(space + word[:-1]) + self._encoded(word[-1:]))
        return self._stored(table, word, self._pieces(space + word))

    def _line(self, line: bytes) -> list[bytes]:
        """Packed ids of words that single spaces part; the space belongs to the word after it."""
        first, *rest = line.split(b" ")
        made = [self._bare.get(first) or self._word(self._bare, first, b"")]
        found = list(map(self._spaced.get, rest))
        if None in found:
            found = [packed or self._word(self._spaced, w, b" ") for packed, w in zip(found, rest)]
        return made + found

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        if self.split_special is None:
            return self._plain(text)
        return b"".join(self.special.get(x) or self._plain(x) for x in self.split_special.split(text) if x)

    def _plain(self, text: bytes) -> bytes:
        # A single space or line end between other characters always starts a word or is one, so
        # words can be looked up whole. No word with space at its ends is in the tables.
        try:
            lines = iter(text.split(b"\n"))
            made = self._line(next(lines))
            for line in lines:
                made.append(self.newline)
                made += self._line(line)
            return b"".join(made)
        except Uneven:
            return self._pieces(text)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are not UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(source: str) -> Codec:
    return Codec(source)


C.worker_table(_codec.cache_clear)


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file for the workers, which may not see the driver's folders."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(source)


def encode(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text", packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens`` and ``token_ids`` (a list, or packed little-endian 32-bit integers)."""

    def ids(texts: list[bytes]) -> list[pa.Array]:
        codec = _codec(vocabulary.value)
        made = [codec.encode(t) for t in texts]
        counts = pa.array([len(m) // 4 for m in made], pa.int64())
        if packed:
            return [counts, pa.array(made, pa.binary())]
        return [counts, C.list_array([np.frombuffer(m, dtype="<i4") for m in made], pa.int32())]

    return C.map_texts(docs, text_col, ids, f"n_tokens long, token_ids {'binary' if packed else 'array<int>'}", keep)


def decode(encoded: DataFrame, vocabulary: Broadcast, keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """Adds the text of ``token_ids``, a list or packed; null ids give an empty text."""
    is_list = encoded.schema["token_ids"].dataType.simpleString() != "binary"

    def texts(_: list[bytes], ids: pa.Array) -> list[pa.Array]:
        codec = _codec(vocabulary.value)
        values = ids.to_pylist()
        if is_list:
            values = [np.array(v or [], dtype="<u4").tobytes() for v in values]
        return [pa.array([codec.decode(v or b"") for v in values], pa.string())]

    held = encoded.withColumn("_none", F.lit("")) if "_none" not in encoded.columns else encoded
    out = C.map_texts(held, "_none", texts, f"`{out_col}` string", [c for c in (keep or encoded.columns)], ["token_ids"])
    return out
