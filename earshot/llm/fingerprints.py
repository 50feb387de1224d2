"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` least hashes of a text's five-word shingles. Sketches of parts merge to the
sketch of the whole, and two of them estimate resemblance, containment and distinct counts. Written
out, a sketch is its hashes in order, 16 hexadecimal digits each; equal texts have equal sketches.

Odd input: null and empty texts have the empty sketch; two empty sketches have resemblance 1, an
empty and a full one 0. ``edited_pairs`` orders rows by id from high to low, null ids last and
equal ids by text, so ties give a defined result; one row alone is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

K = 64
#: Documents of a part of ``edited_pairs``, and the most parts there are.
PART_ROWS = 4_000
MAX_PARTS = 4_096


def sketch(text: bytes, k: int = K) -> np.ndarray:
    """The k least shingle hashes, in order."""
    return C.shingles(text)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else estimated from the k-th least hash."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared shingles among the k least of the union; exact for sets smaller than k."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(union, a), b)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def write(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text or ""), dtype=">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` and ``n_distinct``, the estimated distinct shingles."""
    C.prepare(docs.sparkSession)

    def run(texts: list[bytes]) -> list[pa.Array]:
        made = [sketch(t, k) for t in texts]
        return [pa.array([write(s) for s in made], pa.string()), pa.array([distinct(s, k) for s in made], pa.float64())]

    return C.map_texts(docs, text_col, run, "fingerprint string, n_distinct double", keep)


def merge_by(prints: DataFrame, key_col: str, k: int = K) -> DataFrame:
    """One merged fingerprint for each key (columns key_col and fingerprint).

    Each task first merges what it has of a key, so a key's rows that are shuffled are as many as
    tasks at most, whatever its share of the input.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), pa.array([write(s) for s in held.values()], pa.string())], names=["key", "fingerprint"])
            held.clear()
            return out

        batch = None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[key] = merge(held[key], read(text), k) if key in held else read(text)
            if len(held) > 100_000:
                yield flush()
        if held:
            yield flush()

    slim = prints.select(F.col(key_col).alias("key"), F.col("fingerprint"))
    parts = slim.mapInArrow(partial, slim.schema)
    # Least k of the distinct hashes of the parts, with built-in functions.
    one = F.expr("transform(sequence(0, length(fingerprint) div 16), i -> substring(fingerprint, i * 16 + 1, 16))")
    hashes = F.filter(one, lambda h: F.length(h) == 16)
    whole = parts.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(hashes)))).alias("all"))
    return whole.select(F.col("key").alias(key_col), F.array_join(F.slice("all", 1, k), "").alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness to each other and to the next text.

    The edit replaces the last third of the characters by as many from the start of the next
    document, in order of descending id; the first follows the last. Texts are dealt once into
    ranges of ids and stream through each range in order; each range also gets the first document
    of the range after it.
    """
    C.prepare(docs.sparkSession)
    least = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("rank", F.coalesce("id", least))
    n = base.count()
    parts = max(1, min(MAX_PARTS, n // PART_ROWS))
    cuts = []
    if parts > 1:
        fractions = [i / parts for i in range(1, parts)]
        cuts = sorted(set(base.agg(F.percentile_approx("rank", fractions, 100 * parts)).first()[0]))
    placed = base.withColumn("part", _range_of("rank", cuts))
    heads = {r.part: r.head for r in placed.groupBy("part").agg(F.max("rank").alias("head")).collect()}  # one row a part
    order = sorted(heads, reverse=True)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # a range's first id -> the range before it
    spark = docs.sparkSession
    links = spark.createDataFrame([(h, p) for h, p in before.items()], "head long, prior int")
    both = placed.join(F.broadcast(links), F.col("rank") == F.col("head"), "left")
    roles = F.when(F.col("prior").isNull(), F.array(F.struct("part", F.lit(0).alias("role")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("role")), F.struct(F.col("prior").alias("part"), F.lit(1).alias("role")))
    )
    dealt = (
        both.select(F.explode(roles).alias("at"), "id", "rank", "text")
        .select("at.part", "at.role", "rank", "id", C.utf8("text").alias("text"))
        .repartition(max(parts, 1), "part")
        .sortWithinPartitions("part", "role", F.desc("rank"), "text")
        .select("part", "role", "id", "text")
    )
    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_edit(k), fields).withColumnRenamed("id", id_col)


def _range_of(column: str, cuts: list[int]) -> Column:
    """How many cuts lie below a number; two levels, so that each row looks at few of them."""
    if not cuts:
        return F.lit(0)
    wide = 64
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(column)))
    number = lambda values: F.array(*[F.lit(int(v)) for v in values])
    if len(groups) == 1:
        return below(number(cuts))
    coarse = below(number([g[-1] for g in groups]))  # whole groups below
    fine = F.array(*[number(g) for g in groups])
    return F.least(coarse * wide, F.lit(len(cuts))) + F.when(coarse < len(groups), below(F.get(fine, coarse))).otherwise(0)


def _edit(k: int):
    schema = pa.schema(
        [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, id, text, its sketch), without its next document yet
        for batch in batches:
            out = []
            for part, role, i, raw in zip(*[c.to_pylist() for c in batch.columns]):
                own = sketch(raw, k)
                text = raw.decode("utf-8", "replace")
                if last is not None and last[0] == part:
                    out.append(_compared(last[1], last[2], last[3], text, own, k))
                # The first document of the range after this one closes it.
                last = None if role else (part, i, text, own)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _compared(i: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray, k: int) -> dict:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + following[:cut]).encode()
    made = sketch(edited, k)
    return {
        "id": i,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited).hexdigest(),
        "fingerprint": write(own),
        "edited_fingerprint": write(made),
        "near_edited": resemblance(own, made, k),
        "near_next": resemblance(own, other, k),
    }
