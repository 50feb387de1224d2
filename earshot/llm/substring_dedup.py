"""Substring duplicates by content-defined chunks.

A gear rolling hash over the last 16 bytes marks cuts at word starts, a quarter of them on average
(inside unspaced text, 1 of 16 bytes), so cuts depend on nearby text alone and an
insertion shifts none beyond it. Chunks are known by a 64-bit digest of their bytes without the
space around them. The shortest runs of neighbouring chunks that have ``MIN_WORDS`` words together,
taken from each chunk on and up to each chunk, are windows, known by a digest of their chunks. The
document with the least id keeps a window; in other documents, windows of one keeper that follow
each other chunk by chunk are a repeated span. So a span is a passage that its keeper holds
(but one that repeats a word over and over may be longer than there). Spans of different keepers may
overlap. Shorter passages, as license lines, stay. Repeats inside one
document are left alone.

Digests are counted with a partial aggregate, so a passage that a third of all rows share is one
row per task; what goes back to a document is bounded by its own length.

Unspaced text is what a word has beyond 32 bytes, and beyond 8 bytes the letters of scripts without
spaces (Han, Kana, Thai, Lao, Myanmar, Khmer); each 8 bytes of it count as a word.

Odd input: a null or empty text has no chunk. Rows with a null id are left as they are and make no
other row's passage a repeat. Rows with one id are one document. Repeated rows pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

#: Least words of a run of repeated chunks that counts as a repeated span.
MIN_WORDS = 20

_GEAR = np.random.default_rng(1979).integers(0, 1 << 16, size=256, dtype=np.uint16)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LONG_WORD = 32
#: Bytes of unspaced text that count as one word.
WORD_BYTES = 8


def _unspaced(b: np.ndarray) -> np.ndarray:
    """Bytes of the letters of scripts without spaces."""
    following = np.append(b[1:], np.uint8(0))
    three = (b >= 0xE3) & (b <= 0xE9)  # U+3000 to U+9FFF
    three |= (b == 0xE0) & (following >= 0xB8) & (following <= 0xBB)  # Thai, Lao
    three |= (b == 0xE1) & ((following <= 0x82) | (following == 0x9E) | (following == 0x9F))  # Myanmar, Khmer
    four = (b == 0xF0) & (following >= 0xA0) & (following <= 0xB3)
    out = three | four
    for k in (1, 2):
        out[k:] |= (three | four)[:-k]
    out[3:] |= four[:-3]
    return out


def chunks(text: bytes) -> tuple[list[int], np.ndarray]:
    """Start of each chunk and, at last, the text's end; words before each, in parts of ``WORD_BYTES`` to a word."""
    b = np.frombuffer(text, dtype=np.uint8)
    n = len(b)
    if not n:
        return [0], np.zeros(1, dtype=np.int64)
    blank = _BLANK[b]
    word = ~blank
    word[1:] &= blank[:-1]
    starts = np.flatnonzero(word)
    # Gear hash of the last 16 bytes, by doubling: h[i] = sum of gear[b[i - k]] << k.
    h = _GEAR[b]
    for m in (1, 2, 4, 8):
        later = h[m:] + (h[:-m] << np.uint16(m)) if m < n else h[:0]
        h = np.concatenate([h[: min(m, n)], later])
    at = starts[starts > 0]
    ends = at - 1
    # The hash at the end of the word before: skip the blanks between.
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))
    ends = last[ends]
    cut = at[(ends >= 0) & ((h[ends] >> np.uint16(14)) == 0)]
    wide = int(b.max()) >= 0xE0
    inside = None
    if len(starts) and (wide or int(np.diff(np.append(starts, n)).max()) > _LONG_WORD):
        place = np.searchsorted(starts, np.arange(n), side="right") - 1
        since = np.arange(n) - np.where(place >= 0, starts[np.maximum(place, 0)], 0)
        inside = ~blank & (since >= _LONG_WORD)
        if wide:
            inside |= _unspaced(b) & (since >= WORD_BYTES)
        cut = np.union1d(cut, np.flatnonzero(inside & ((h >> np.uint16(12)) == 0) & ((b & 0xC0) != 0x80)))
    bounds = [0, *cut.tolist(), n]
    before = np.searchsorted(starts, bounds) * WORD_BYTES
    if inside is not None:
        before += np.concatenate([[0], np.cumsum(inside)])[bounds]
    return bounds, before


def digests(text: bytes, bounds: list[int]) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(text[i:j].strip()) for i, j in zip(bounds, bounds[1:])]


def windows(text: bytes, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """First chunk, chunk after the last, and digest of each window; bounds, and words before each, as of ``chunks``."""
    bounds, before = chunks(text)
    least = min_words * WORD_BYTES
    n = len(bounds) - 1
    k = np.arange(n)
    # From each chunk on the least end that gives enough words, and up to each chunk the last start.
    last = np.searchsorted(before, before[:-1] + least, "left")
    first = np.searchsorted(before, before[1:] - least, "right") - 1
    full, whole = last <= n, first >= 0
    pairs = np.unique(np.concatenate([k[full] * (n + 1) + last[full], first[whole] * (n + 1) + k[whole] + 1]))
    begin, end = pairs // (n + 1), pairs % (n + 1)
    if not len(pairs):
        return begin, end, np.empty(0, dtype=np.int64), bounds, before
    own = np.array(digests(text, bounds), dtype=np.uint64).tobytes()
    digest = xxhash.xxh3_64_intdigest
    made = [digest(own[8 * i : 8 * j]) for i, j in zip(begin.tolist(), end.tolist())]
    return begin, end, np.array(made, dtype=np.uint64).view(np.int64), bounds, before


def _rows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, h) for the distinct windows of each text."""
    C.use(__name__)
    for batch in batches:
        ids, made = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                own = np.unique(windows(text, min_words)[2])
                made.append(own)
                ids.append(np.full(len(own), i, dtype=np.int64))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(made))], names=["id", "h"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, each with its repeated spans: structs of byte range, words and the keeper's id.

    The result has the columns ``row`` (the input row as a struct) and ``spans``.
    """
    C.prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), C.utf8(text_col).alias("text")).where("id IS NOT NULL")
    rows = slim.mapInArrow(lambda batches: _rows(batches, min_words), "id long, h long")
    shared = rows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first")
    marked = (
        rows.join(shared, "h")
        .where("id > first")
        .groupBy("id")
        .agg(F.collect_set(F.struct("h", "first")).alias("marks"))  # at most the windows of one document
    )
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    joined = base.join(marked, "id", "left").select("row", F.col(f"row.`{text_col}`").alias("text"), F.col("marks.h").alias("h"), F.col("marks.first").alias("first"))

    def spans(texts: list[bytes], h: pa.Array, first: pa.Array) -> list[pa.Array]:
        out = []
        for text, hs, firsts in zip(texts, h.to_pylist(), first.to_pylist()):
            out.append(_runs(text, dict(zip(hs, firsts)), min_words) if hs and text else [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("keeper", pa.int64())]))
        return [pa.array(out, kind)]

    fields = "spans array<struct<start: long, end: long, n_words: long, keeper: long>>"
    return C.map_texts(joined, "text", spans, fields, ["row"], ["h", "first"])


def _runs(text: bytes, marks: dict[int, int], min_words: int) -> list[dict]:
    """The marked windows; those of one keeper that follow each other, chunk by chunk, are one span."""
    begin, end, own, bounds, before = windows(text, min_words)
    spans: list[list[int]] = []
    held = None  # the keeper of the window before
    for i, j, h in zip(begin.tolist(), end.tolist(), own.tolist()):
        keeper = marks.get(h)
        if keeper is not None and keeper == held:
            spans[-1][1] = max(spans[-1][1], j)
        elif keeper is not None:
            spans.append([i, j, keeper])
        held = keeper
    return [{"start": bounds[i], "end": bounds[j], "n_words": int(before[j] - before[i]) // WORD_BYTES, "keeper": keeper} for i, j, keeper in spans]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their repeated spans cut out of the text.

    A document of which nothing but space is left goes; other columns stay as they are.
    """
    found = repeated_spans(docs, id_col, text_col, min_words)

    def cut(texts: list[bytes], spans: pa.Array) -> list[pa.Array]:
        out = []
        for text, at in zip(texts, spans.to_pylist()):
            start, pieces = 0, []
            for s in at:
                pieces.append(text[start : s["start"]])
                start = max(start, s["end"])
            out.append(b"".join([*pieces, text[start:]]))
        return [pa.array(out, pa.binary()).cast(pa.string())]

    held = found.select("row", "spans", F.col(f"row.`{text_col}`").alias("text"))
    done = C.map_texts(held, "text", cut, "clean string", ["row", "spans"], ["spans"])
    done = done.where((F.size("spans") == 0) | F.col("clean").rlike(r"[^\x09-\x0D ]"))
    text = F.when(F.size("spans") > 0, F.col("clean")).otherwise(F.col(f"row.`{text_col}`"))
    return done.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
