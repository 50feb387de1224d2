"""Shards along a Hilbert curve over quantised metadata, near equal in bytes.

Rows with equal texts are a group that stays together. Groups are put in order of the Hilbert index
of their quantised size, language and source, and the order is cut into runs of near equal bytes,
so each shard covers a small box of the metadata and readers can skip whole files. Groups of more
than a hundredth of a shard are placed first, largest first into the emptiest shard; only a group
that is larger than what a shard can take is split.

No step gathers a group: rows of a group are numbered in ``SALTS`` parts, prefix sums go over at
most ``MAX_BINS`` ranges of the order, and only sums of those ranges and the few large groups come
to the driver.

Odd input: a null text has size 1 and counts as an empty one. Null metadata is the least code.
Null and repeated ids and repeated rows each get a slot of their own. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import common as C
from earshot.llm.fingerprints import _range_of

LAW = "bytes"
#: Columns that ``assign`` adds; an input column of the same name gives way.
MADE = ("size", "text_crc32", "shard", "slot")
SALTS = 1_024
BITS = 8
GROUPS_PER_BIN = 50_000
MAX_BINS = 4_096
#: A group is large from this part of a shard on; there are at most n_shards times this many.
LARGE = 100


def hilbert_index(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points (one row each) with ``bits`` bits a dimension.

    The published transposition (Skilling 2004), on whole columns.
    """
    x = codes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _text_codes(groups: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Up to 2 ** BITS - 1 frequent values of a column, in order, and a code for each.

    Codes follow the share of groups at or below a value, so they fill the range of a dimension.
    """
    top = groups.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull()).orderBy(F.desc("n"), column).limit((1 << BITS) - 1).collect()
    top = sorted((r[0], r[1]) for r in top)
    share = np.cumsum([n for _, n in top]) / max(1, sum(n for _, n in top))
    return np.array([v for v, _ in top], dtype=object), np.array([0, *np.round(share * ((1 << BITS) - 1)).astype(np.int64)])


def curve(groups: DataFrame, size: str, names: list[str]) -> DataFrame:
    """Adds ``curve``: the Hilbert index of the size (by quantiles) and of the named text columns."""
    codes = {c: _text_codes(groups, c) for c in names}
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    sizes = np.array(groups.agg(F.percentile_approx(size, steps, 10_000)).first()[0] or [], dtype=np.int64)

    def index(*columns: pd.Series) -> pd.Series:
        points = [np.searchsorted(sizes, columns[0].to_numpy(dtype=np.int64), side="right")]
        for name, column in zip(names, columns[1:]):
            values, code = codes[name]
            known = column.notna().to_numpy()
            place = np.zeros(len(column), dtype=np.int64)
            if len(values) and known.any():
                place[known] = np.searchsorted(values, column[known].to_numpy(dtype=object), side="right")
            points.append(code[place])
        return pd.Series(hilbert_index(np.array(points).T.reshape(len(columns[0]), len(points))))

    return groups.withColumn("curve", F.pandas_udf(index, "long")(size, *names))


def assign(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), keep: list[str] | None = None) -> DataFrame:
    """Adds size, text_crc32, shard and slot (gapless from 0 in each shard) to the documents."""
    C.prepare(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"m{i}" for i in range(len(by))]
    raw = C.utf8(text_col)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in MADE], F.lit(0).alias("_")).alias("row"),
        F.col(id_col).cast("string").alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
        F.xxhash64(raw).alias("h"),
        *[F.col(c).cast("string").alias(m) for c, m in zip(by, names)],
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    group = ["h", "crc", "size"]
    # Rows of each part of a group, and how many of the group come before them.
    parts = rows.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("n"), *[F.min(m).alias(m) for m in names]).checkpoint()
    groups = parts.groupBy(*group).agg(F.sum("n").alias("n"), *[F.min(m).alias(m) for m in names]).withColumn("bytes", F.col("n") * F.col("size"))
    groups = curve(groups.checkpoint(), "size", names).checkpoint()
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    target = total[0] / n_shards
    large = groups.where(F.col("bytes") > target / LARGE).orderBy(F.desc("bytes"), *group).collect()  # n_shards * LARGE at most
    pieces, filled, rows_in = _place_large(large, n_shards, target)
    light = _place_light(groups.where(F.col("bytes") <= target / LARGE), total[1], n_shards, target, filled, rows_in)
    # Where the rows of a group go: from row number `first` on, to `shard` at slot `base` on.
    large_rows = spark.createDataFrame(pieces, "h long, crc long, size long, first long, until long, shard int, base long")
    placed = light.unionByName(large_rows)
    w = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    offsets = parts.select(*group, "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.col("n").alias("n_part"))
    homes = offsets.join(placed, group).where((F.col("first") < F.col("before") + F.col("n_part")) & (F.col("until") > F.col("before")))
    nth = F.row_number().over(Window.partitionBy(*group, "salt").orderBy("id")) - 1
    numbered = rows.drop(*names).withColumn("nth", nth)
    joined = numbered.join(homes, [*group, "salt"]).withColumn("number", F.col("before") + F.col("nth"))
    mine = joined.where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("until")))
    return mine.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.schema["row"].dataType.names if c != "_"], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("number") - F.col("first")).alias("slot"))


def _place_large(large: list, n_shards: int, target: float) -> tuple[list[tuple], list[int], list[int]]:
    """Large groups into the emptiest shards; a group is split only where it overfills one."""
    filled, rows_in, pieces = [0] * n_shards, [0] * n_shards, []
    for g in large:
        first = 0
        while first < g.n:
            s = min(range(n_shards), key=filled.__getitem__)
            room = int((target * (1 + 1 / LARGE) - filled[s]) // g.size)
            last_resort = g.size > target  # one text larger than a shard
            take = min(g.n - first, max(room, 1 if last_resort or room < 1 else 0))
            pieces.append((g.h, g.crc, g.size, first, first + take, s, rows_in[s]))
            filled[s] += take * g.size
            rows_in[s] += take
            first += take
    return pieces, filled, rows_in


def _place_light(light: DataFrame, n_groups: int, n_shards: int, target: float, filled: list[int], rows_in: list[int]) -> DataFrame:
    """Runs of the curve order, each as long as its shard has room."""
    spark = light.sparkSession
    room = np.cumsum([max(target - f, 0.0) for f in filled])
    # Curve index first, then the group's hash: a number that orders the groups.
    place = F.shiftleft("curve", 63 - 24) + F.shiftrightunsigned("h", 25)
    keyed = light.withColumn("place", place)
    bins = max(1, min(MAX_BINS, n_groups // GROUPS_PER_BIN))
    cuts = []
    if bins > 1:
        cuts = sorted(set(keyed.agg(F.percentile_approx("place", [i / bins for i in range(1, bins)], 100 * bins)).first()[0] or []))
    keyed = keyed.withColumn("bin", _range_of("place", cuts))
    sums = sorted((r.bin, r.b, r.n) for r in keyed.groupBy("bin").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).collect())  # MAX_BINS at most
    starts, b, n = [], 0, 0
    for k, more_b, more_n in sums:
        starts.append((k, b, n))
        b, n = b + more_b, n + more_n
    room = room * (b / room[-1]) if b and room[-1] > 0 else room
    start = F.broadcast(spark.createDataFrame(starts, "bin int, b0 long, n0 long"))
    before = Window.partitionBy("bin").orderBy("place", "h", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = (
        keyed.withColumn("b1", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .withColumn("n1", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(start, "bin")
        .withColumn("middle", F.col("b0") + F.col("b1") + F.col("bytes") / 2)
        .withColumn("from", F.col("n0") + F.col("n1"))
        .withColumn("shard", F.least(F.size(F.filter(F.array(*[F.lit(float(x)) for x in room]), lambda x: x < F.col("middle"))), F.lit(n_shards - 1)))
        .select("h", "crc", "size", "n", "from", "shard")
        .checkpoint()
    )
    firsts = {r.shard: r.least for r in run.groupBy("shard").agg(F.min("from").alias("least")).collect()}  # one row a shard
    base = F.array(*[F.lit(int(rows_in[s] - firsts.get(s, 0))) for s in range(n_shards)])
    return run.select("h", "crc", "size", F.lit(0).cast("long").alias("first"), F.col("n").alias("until"), "shard", (F.get(base, F.col("shard")) + F.col("from")).alias("base"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, files_per_shard: int = 4, **options) -> None:
    """Write the documents with one folder a shard, in curve order, for pruning by file statistics."""
    placed = assign(docs, n_shards, **options)
    placed.repartitionByRange(n_shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
