import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import common, fingerprints as P


def sets(n_both, n_a, n_b, seed=1):
    x = np.random.default_rng(seed).integers(0, 1 << 63, n_both + n_a + n_b, dtype=np.uint64) * np.uint64(2)
    return np.sort(x[: n_both + n_a]), np.sort(np.concatenate([x[:n_both], x[n_both + n_a :]]))


def test_estimates():
    a, b = sets(20, 10, 5)
    assert P.resemblance(a, b) == 20 / 35 and P.distinct(a) == 30 and P.containment(a, b) == pytest.approx(20 / 30)
    a, b = sets(30_000, 10_000, 10_000)
    k = 1024
    x, y = a[:k], b[:k]
    assert P.resemblance(x, y, k) == pytest.approx(0.6, abs=0.06)
    assert P.distinct(x, k) == pytest.approx(40_000, rel=0.12)
    assert P.containment(x, y, k) == pytest.approx(0.75, abs=0.1)
    none = a[:0]
    assert P.resemblance(none, none) == 1 and P.resemblance(none, a) == 0 and P.distinct(none) == 0
    assert (P.read(P.write(x)) == x).all() and P.write(none) == ""


def test_merge_by_is_the_sketch_of_the_whole(spark, prose):
    rows = [(k % 3, prose(k, 120)) for k in range(30)] + [(None, prose(1, 9)), (7, "")]
    docs = spark.createDataFrame(rows, "g long, text string").repartition(6)
    merged = {r.g: r.fingerprint for r in P.merge_by(P.fingerprints(docs), "g").collect()}
    for g in (0, 1, 2, None, 7):
        parts = [common.shingles(t.encode()) for k, t in rows if k == g]
        assert merged[g] == P.write(np.unique(np.concatenate(parts))[: P.K])


@pytest.mark.parametrize("part_rows", [4_000, 7])
def test_edits_match_brute_force(spark, monkeypatch, prose, part_rows):
    monkeypatch.setattr(P, "PART_ROWS", part_rows)
    rng = random.Random(2)
    docs = [(rng.choice([-5, 3, 10**12]) + 17 * k, rng.choice([prose(k, rng.randint(0, 90)), "é漢\U0001f600" * rng.randint(0, 4), None])) for k in range(60)]
    got = {r.doc_id: r for r in P.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        s = [P.sketch(t.encode()) for t in (text, edited, following)]
        assert (r.fingerprint, r.edited_fingerprint) == (P.write(s[0]), P.write(s[1]))
        assert (r.near_edited, r.near_next) == (P.resemblance(s[0], s[1]), P.resemblance(s[0], s[2]))


def test_odd_rows(spark, odd_docs):
    docs = odd_docs()
    assert P.edited_pairs(docs).count() == docs.count()
    assert P.edited_pairs(docs.limit(0)).count() == 0
    one = P.edited_pairs(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert P.fingerprints(docs).where(F.col("text").isNull() & (F.col("fingerprint") != "")).count() == 0


def test_ranges_of_many_cuts(spark):
    for cuts in ([], [5], list(range(0, 1000, 3)), list(range(64)), list(range(128))):
        got = spark.range(-2, 1100).select("id", P._range_of("id", cuts).alias("p")).collect()
        assert all(r.p == sum(c < r.id for c in cuts) for r in got)
