import hashlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from earshot.operators import bootstrap as B
from earshot.operators import draws as D
from earshot.operators import topics as T


def plain(text, first, last, n):
    return [int(hashlib.md5(f"{text}{j}".encode()).hexdigest()[:15], 16) % n for j in range(first, last)]


@pytest.mark.parametrize("text", ["", "777:i:3:", "é:1:", "x" * 47 + ":", "y" * 52, "z" * 60, "w" * 130])
def test_stretches_against_hashlib(text):
    for first, last, n in ((0, 12_345, 997), (3, 12, 10), (19_990, 30_010, 10**9), (9, 1005, 7), (123_449_990, 123_450_003, 2**40)):
        assert D.stretch(text, first, last, n).tolist() == plain(text, first, last, n)


def test_draws_in_long_ranges_are_counted_by_their_ends():
    at = np.sort(np.random.default_rng(4).integers(0, 1000, 5000))
    starts, ends = np.array([0, 100, 400, 990]), np.array([100, 130, 700, 1000])
    counts, others = D.apart(at, starts, ends)
    inside = [(at >= lo) & (at < hi) for lo, hi in zip(starts, ends)]
    assert counts.tolist() == [int(i.sum()) for i in inside]
    assert others.tolist() == at[~np.any(inside, axis=0)].tolist()


def test_draws_are_packed_not_sent_one_by_one(spark):
    n, width = 2_500_000, D.chunk_width(200)
    starts, ends = np.array([0]), np.array([500_000])
    tasks = spark.createDataFrame([("k", "t:0:", n, 0, at) for at in range(0, n, D.STRETCH)], "key string, text string, n long, b long, first long")
    rows = D.packed_draws(tasks, ["key"], width, (starts, ends)).toPandas()
    assert len(rows) <= 3 * (n // width + 2) and set(rows["key"]) == {"k"}
    want = np.bincount(D.stretch("t:0:", 0, n, n), minlength=n)
    assert rows["times"].sum() == n and rows.loc[rows["chunk"] == -1, "times"].sum() == want[:500_000].sum()
    got = np.zeros(n + width, dtype=np.int64)
    for chunk, group in rows[rows["chunk"] >= 0].groupby("chunk"):
        ((_, times),) = D.times_drawn(group, width)
        got[chunk * width : (chunk + 1) * width] += times
    assert (got[500_000:n] == want[500_000:]).all() and got[:500_000].sum() == 0


def test_counter_draws_over_frequent_and_rare_kinds(spark, monkeypatch):
    """Chunks smaller than some kinds, and kinds that lie across chunks."""
    monkeypatch.setattr(D, "chunk_width", lambda b: 16)
    sizes = [1, 1, 2, 40, 1, 7, 1, 90, 2, 1, 3, 1]
    rows = [("ab"[i % 2], f"k{i:02d}", m, [("x", 1 + i), ("y", 2)]) for i, m in enumerate(sizes)]
    kinds = spark.createDataFrame(rows, "key string, kind string, m long, cells array<struct<cell:string,n:long>>")
    got = {(r["b"], r["key"], r["cell"]): r["w"] for r in B._counter_draws(kinds, sum(sizes), len(sizes), 5, 777, "c").groupBy("b", "key", "cell").agg(F.sum("w").alias("w")).collect()}
    owner = np.repeat(np.arange(len(sizes)), sizes)
    want = {}
    for b in range(5):
        for at in plain(f"777:c:{b}:", 0, sum(sizes), sum(sizes)):
            key, _, _, cells = rows[owner[at]]
            for cell, n in cells:
                want[b, key, cell] = want.get((b, key, cell), 0) + n
    assert got == want


def test_topic_intervals_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "chunk_width", lambda b: 8)
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], f"{i % 3:04d}", f"u{i:03d}", *map(int, rng.integers(0, 4, 3))) for i in range(150)]
    units = spark.createDataFrame(rows, "brand string, cid string, cluster_key string, pos long, neg long, neu long").withColumn("n", F.lit(1))
    got = {(r["brand"], r["cid"]): (r["ci_lo"], r["ci_hi"]) for r in T.topic_intervals(units, b=20, method="counter").collect()}
    assert len(got) == 6
    for (brand, cid), ends in got.items():
        mine = np.array([r[3:] for r in sorted(rows, key=lambda r: r[2]) if r[:2] == (brand, cid)])
        sums = [mine[plain(f"777:t:{brand}:{cid}:{b}:", 0, len(mine), len(mine))].sum(axis=0) for b in range(20)]
        nets = [(p - n) / (p + n + u) for p, n, u in sums]
        assert np.allclose(ends, np.quantile(nets, [0.025, 0.975]))
