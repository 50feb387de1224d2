"""Helpers of the text operators: rows through Arrow batches, word hashes, shingles, disjoint sets.

All operators follow the same rules for odd input. A null text counts as an empty one. Every input
column is kept beside the computed ones where an operator returns its input, whatever its name.
Texts are read whole; rows travel in Arrow batches of bounded size, so memory follows the longest
single text and not the partition.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.settings import checkpoint_dir, tune

#: Words of a shingle, and the least resemblance (in percent) of near duplicates.
SHINGLE_WORDS = 5
NEAR_PERCENT = 75

#: Rows of an Arrow batch; Spark also bounds its bytes (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 512

#: Entries of a worker's word table; it starts anew when it is full.
CACHE_WORDS = 400_000
#: Bytes of a worker's table of word hashes, about, and the longest word that it keeps.
HASH_BYTES = 32 << 20
LONGEST_KEY = 64

_U = np.uint64
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of the text operators and the folder for checkpoints."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_dir(spark)
    return spark


def utf8(column: str) -> Column:
    """The bytes of a text column, nothing for null."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


_clears: list[Callable[[], object]] = []
_owner: list[str] = []


def worker_table(clear: Callable[[], object]) -> None:
    """Names what empties a table that Python workers keep between tasks."""
    _clears.append(clear)


def use(owner: str) -> None:
    """Called where a task's work starts. Workers are reused: when another operator begins, the tables
    of the one before are dropped and their memory goes back to the system.
    """
    if _owner == [owner]:
        return
    first = not _owner
    _owner[:] = [owner]
    if first:
        # What Arrow has freed goes back to the system and is not kept for later batches.
        pa.set_memory_pool(pa.system_memory_pool())
        return
    for clear in _clears:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[bytes]], list[pa.Array]],
    fields: str,
    keep: list[str] | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (all by default) and what ``fn`` makes of the texts of each batch, as columns ``fields``.

    ``fn`` gets the texts as UTF-8 bytes and, after them, one Arrow array for each column in
    ``extra``. Kept columns travel inside one struct, so no name can clash; an input column with
    the name of a computed one gives way to it.
    """
    names = df.columns if keep is None else keep
    extra = extra or []
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    packed = df.select(row.alias("row"), utf8(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    out = T.StructType([packed.schema["row"], *T.StructType.fromDDL(fields).fields])
    outs = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(fn.__module__)
        for batch in batches:
            made = fn(batch.column(1).to_pylist(), *[batch.column(2 + i) for i in range(len(extra))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=outs)

    done = packed.mapInArrow(run, out)
    new = outs[1:]
    kept = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names) if c not in new]
    return done.select(*kept, *new)


class WordHashes(dict):
    """Word bytes -> 64-bit hash, filled on first use and bounded in bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEY:
            # A key of average length, a number and the table's slot are about 160 bytes.
            if len(self) >= HASH_BYTES // 160:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()
worker_table(_HASHES.clear)


def lower_words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at space and 0x09-0x0D."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text.

    A text of fewer words is one shingle, a text without words has none.
    """
    words = lower_words(text)
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    if n < SHINGLE_WORDS:
        # The count of words keeps short sequences apart from each other and from full shingles.
        return mix((h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
    n -= SHINGLE_WORDS - 1
    total = h[:n] * _ODD[0]
    for k in range(1, SHINGLE_WORDS):
        total += h[k : n + k] * _ODD[k]
    return np.unique(mix(total))


def word_parts(words: list[str], most: int = 500_000) -> Iterator[list[str]]:
    """The words in parts of about ``most`` characters; a longer word is a part of its own."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > most:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


def char_grams(words: list[str], orders: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of whole words with marked ends: buckets, and the word each belongs to.

    All words are handled at once, as one array of code points.
    """
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    end = np.cumsum(sizes)[owner] if len(marked) else np.empty(0, np.int64)
    place = np.arange(len(points))
    rows, owners = [], []
    for n in orders:
        at = place[place + n <= end]
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = h * _ODD[0] + points[at + k]
        rows.append((mix(h) % _U(buckets)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(rows), np.concatenate(owners)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per row of numpy parts."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


#: Ids that are sent to every worker (8 bytes each, before the hash table), at most.
MAX_BROADCAST_IDS = 1_000_000


def id_filter(ids: DataFrame) -> DataFrame:
    """Ids for a semi or anti join, written to the shared folder: sent to every worker if they are
    at most ``MAX_BROADCAST_IDS``, so that texts stay where they are; a plain join side beyond that.
    """
    done = ids.checkpoint()
    return F.broadcast(done) if done.count() <= MAX_BROADCAST_IDS else done


def crc_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of an id as text, modulo ``buckets``; ids that are null count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


#: Edges of a partition of a graph; smaller graphs take fewer partitions.
EDGES_PER_PART = 200_000


def _packed(edges: DataFrame) -> DataFrame:
    """Edges written to the shared folder, in as few partitions as they fill."""
    done = edges.checkpoint()
    parts = -(-done.count() // EDGES_PER_PART)
    return done.coalesce(max(1, parts)) if parts < done.rdd.getNumPartitions() else done


def tree_roots(parents: DataFrame) -> DataFrame:
    """Stars (u, root) of a forest given as (u, v) with one v < u for each u, by pointer jumping."""
    now = _packed(parents.select("u", "v"))
    while True:
        up = now.select(F.col("u").alias("v"), F.col("v").alias("top"))
        jumped = _packed(now.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v"), F.col("top").isNotNull().alias("moved")))
        now = jumped.select("u", "v")
        if jumped.where("moved").isEmpty():
            return now.select("u", F.col("v").alias("root"))


def min_label_edges(edges: DataFrame) -> DataFrame:
    """Stars (u, root) of the connected components of edges (u, v): root is the least id; u > root.

    Alternating large and small stars. Each step is a partial aggregate and a join, so a hub's
    edges are never gathered; each round is checkpointed, and the loop ends when nothing changes.
    """
    one_way = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = _packed(one_way.distinct())
    while True:
        # Done when no node has two lower neighbours, and none has lower and higher ones.
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        roles = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if roles.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return now.select("u", F.col("v").alias("root"))
        # Large star: neighbours above u are linked to the least of u and its neighbours.
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = now.union(up).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its lower neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = _packed(small.where(F.col("u") != F.col("v")).distinct())


def fresh_name() -> str:
    """A name for a new table in the shared folder."""
    return uuid.uuid4().hex
