import numpy as np
from pyspark.sql import functions as F

from earshot.operators import topics as T
from earshot.operators import vectors as V


def greedy(vectors, cut):
    """Average linkage the plain way: one merge at a time over the full distance matrix."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    groups = [[i] for i in range(len(unit))]
    while len(groups) > 1:
        best = min(
            (np.mean(d[np.ix_(a, b)]), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def cloud(seed=5, n=70):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6))
    points = centres[rng.integers(0, 8, n)] + rng.normal(scale=0.45, size=(n, 6))
    points[n // 2 : n // 2 + 12] = points[0]  # a pile of copies
    return points


def frame(spark, points, brand="a"):
    rows = [(brand, f"m{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "brand string, mention_id string, vector array<double>")


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["brand"], r["cid"]), set()).add(int(r["mention_id"][1:]))
    return {frozenset(g) for g in out.values()}


def test_linkage_equals_one_merge_at_a_time(spark):
    for seed in (5, 6):
        points = cloud(seed)
        unit = V.with_unit_vectors(frame(spark, points))
        want = greedy(points, 0.35)
        assert len(want) > 2
        assert groups_of(V.average_linkage(unit, 0.35)) == want


def test_distributed_rounds_give_the_same_clusters(spark):
    points = cloud(9, 60)
    unit = V.with_unit_vectors(frame(spark, points))
    assert groups_of(V.average_linkage(unit, 0.35, block=16, small=0)) == greedy(points, 0.35)


def test_mean_link_is_not_single_link(spark):
    # A chain: every neighbour is inside the cut, the ends are not.
    angles = np.deg2rad([0, 38, 80, 118])
    points = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    unit = V.with_unit_vectors(frame(spark, points))
    assert groups_of(V.average_linkage(unit, 0.35)) == {frozenset({0, 1}), frozenset({2, 3})}


def test_zero_vector_and_nothing(spark):
    unit = V.with_unit_vectors(frame(spark, np.array([[0.0, 0.0], [1.0, 0.0]])))
    assert len(groups_of(V.average_linkage(unit, 0.35))) == 2
    assert V.average_linkage(unit.limit(0), 0.35).count() == 0


def test_close_pairs_with_copies(spark):
    points = cloud(7, 40)
    unit = V.with_unit_vectors(frame(spark, points))
    got = V.close_pairs(unit, 0.1, block=8).collect()
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    first = {}
    for i, p in enumerate(map(tuple, u)):
        first.setdefault(p, []).append(i)
    names = [v[0] for v in first.values()]
    want = {(a, b) for a in names for b in names if a < b and 1 - u[a] @ u[b] <= 0.1}
    assert {(int(r["a"][1:]), int(r["b"][1:])) for r in got} == want and len(got) == len(want)
    assert max(max(r["copies_a"], r["copies_b"]) for r in got) >= 12 or not got


def test_top_k_many_equals_brute_force(spark):
    points = cloud(8, 50)
    unit = V.with_unit_vectors(frame(spark, points))
    asked = unit.limit(6).select(F.col("mention_id").alias("question_id"), "unit")
    got = {}
    for r in V.cosine_top_k_many(unit, asked, 5).orderBy("rank").collect():
        got.setdefault(r["question_id"], []).append(r["mention_id"])
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    for question, found in got.items():
        s = u @ u[int(question[1:])]
        want = sorted(range(50), key=lambda i: (-round(s[i], 12), i))[:5]
        assert sorted(round(s[int(m[1:])], 9) for m in found) == sorted(round(s[i], 9) for i in want)
    assert len(got) == 6


def test_topics_end_to_end(spark):
    points = np.array([[1, 0], [0.99, 0.1], [0.98, 0.12], [0, 1], [0.1, 1], [-1, 0]], dtype=float)
    rows = [
        ("Itaú", f"m{i:03d}", f"k{i % 2}", ("positive", "negative", "positive")[i % 3], "ok", True, ["t"])
        for i in range(6)
    ] + [("few", "m900", "k", "neutral", "ok", True, ["t"])]
    labelled = spark.createDataFrame(rows, "brand string, mention_id string, cluster_key string, label string, status string, about_brand boolean, matched_terms array<string>")
    vectors = frame(spark, points, "Itaú")
    got = T.build_topics(labelled, vectors, b=50)
    topic = got["topics"].collect()
    assert [(t["topic_id"], t["n"], t["n_clusters"], t["name"]) for t in topic] == [("itau-01", 3, 2, "Itaú topic 01")]
    assert topic[0]["share"] == 0.5 and abs(topic[0]["net"] - 1 / 3) < 1e-12
    assert topic[0]["ci_lo"] <= topic[0]["net"] <= topic[0]["ci_hi"]
    assert len(topic[0]["exemplar_mention_ids"]) == 3
    assert got["assignments"].count() == 3
    assert [(r["brand"], r["reason"]) for r in got["abstentions"].collect()] == [("few", "below_minimum")]


def groups_in_space(seed=11, groups=24, each=18, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.concatenate([c + rng.normal(scale=0.12, size=(each, dims)) for c in centres])


def test_pivots_skip_blocks_that_cannot_be_near(spark, monkeypatch):
    points = groups_in_space()
    unit = V.with_unit_vectors(frame(spark, points))
    rows = V.distinct_vectors(unit).drop("vkey")
    tasks = V.block_tasks(rows, 0.1, 16).cache()
    blocks = tasks.filter("_side = 0").select("_cell", "_block").distinct().count()
    met = tasks.select(*V._TASK).distinct().count()
    assert blocks >= 27 and met < 0.6 * blocks * (blocks + 1) / 2
    # Every near pair is found once all the same.
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.1
    tasks.unpersist()
    got = V.close_pairs(unit, 0.1, block=16).collect()
    assert sorted((int(r["a"][1:]), int(r["b"][1:])) for r in got) == [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if near[i, j]]
    monkeypatch.setattr(V, "PLAIN_BLOCKS", 1)
    assert groups_of(V.average_linkage(unit, 0.1, block=64, small=200)) == groups_of(V.average_linkage(unit, 0.1))


def test_cells_larger_than_a_block_and_wide_cuts(spark, monkeypatch):
    points = cloud(4, 90)
    unit = V.with_unit_vectors(frame(spark, points))
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    first = {}
    for i, p in enumerate(map(tuple, u)):
        first.setdefault(p, i)
    names = sorted(first.values())
    monkeypatch.setattr(V, "MAX_PIVOTS", 3)
    for cut, plain in ((0.3, 1), (1.2, 1), (0.3, 99)):
        monkeypatch.setattr(V, "PLAIN_BLOCKS", plain)
        want = {(a, b) for a in names for b in names if a < b and 1 - u[a] @ u[b] <= cut}
        got = V.close_pairs(unit, cut, block=6).collect()
        assert len(got) == len(want) and {(int(r["a"][1:]), int(r["b"][1:])) for r in got} == want
    # Rounds end in one task once a brand is small enough.
    assert groups_of(V.average_linkage(unit, 0.35, block=8, small=30)) == greedy(points, 0.35)


def test_rounds_do_not_multiply_the_planned_size(spark, monkeypatch):
    seen, nearest = [], V._nearest

    def watched(rows, cut, block):
        seen.append(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return nearest(rows, cut, block)

    monkeypatch.setattr(V, "_nearest", watched)
    unit = V.with_unit_vectors(frame(spark, cloud(9, 30)))
    V.average_linkage(unit, 0.35, block=16, small=0)
    assert len(seen) > 2 and max(seen) < 64


def test_vectors_are_sent_by_runs_of_blocks_not_by_cells(spark, monkeypatch):
    """With a wide cut each cell is near each other; a visit of all vectors to all cells was 40 times this table."""
    points = np.random.default_rng(3).normal(size=(300, 8))
    unit = V.with_unit_vectors(frame(spark, points))
    rows = V.distinct_vectors(unit).drop("vkey").cache()
    monkeypatch.setattr(V, "PLAIN_BLOCKS", 1)
    monkeypatch.setattr(V, "SIDE_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(V, "SLICE", 64)
    held = F.sum(F.size("cids"))
    tasks = V.block_tasks(rows, 0.8, 10).groupBy(*V._TASK, "_side").agg(held.alias("n"), F.sum(F.size("meets")).alias("met")).collect()
    runs = len({t["_cell"] for t in tasks})
    assert 300 / 50 <= runs <= 12 and sum(t["n"] for t in tasks) <= 300 * runs and max(t["n"] for t in tasks) <= 60
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.8
    got = V.close_pairs(unit, 0.8, block=10).collect()
    assert sorted((int(r["a"][1:]), int(r["b"][1:])) for r in got) == [(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]]
    assert groups_of(V.average_linkage(unit, 0.5, block=10, small=0)) == groups_of(V.average_linkage(unit, 0.5))


def test_blocks_without_near_cells_are_not_compared(spark):
    unit = V.with_unit_vectors(frame(spark, groups_in_space()))
    tasks = V.block_tasks(V.distinct_vectors(unit).drop("vkey"), 0.1, 16).filter("_side = 0")
    blocks, met = tasks.agg(F.countDistinct("_block"), F.sum(F.size("meets"))).first()
    assert blocks >= 27 and met < 0.6 * blocks * (blocks + 1) / 2


def test_of_equal_distances_the_lowest_pair_is_taken(spark, monkeypatch):
    """Axes and their opposites: all others but the opposite are at distance 1, also in other blocks and runs."""
    points = np.concatenate([-np.eye(6), np.eye(6)])
    rows = V.distinct_vectors(V.with_unit_vectors(frame(spark, points))).drop("vkey")
    monkeypatch.setattr(V, "SIDE_BYTES", 64)
    monkeypatch.setattr(V, "SLICE", 4)
    got = {r["cid"]: (r["a"], r["b"]) for r in V._nearest(rows, 1.0, 3).collect()}
    lowest = {i: next(j for j in range(12) if j not in (i, (i + 6) % 12)) for i in range(12)}
    assert got == {f"m{i:03d}": (f"m{min(i, j):03d}", f"m{max(i, j):03d}") for i, j in lowest.items()}


def test_only_fresh_clusters_look_for_a_neighbour_again(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 4))
    rows = V.distinct_vectors(V.with_unit_vectors(frame(spark, points))).drop("vkey")
    want = {r["cid"]: (r["a"], r["b"]) for r in V._nearest(rows, 0.9, 8).collect()}
    known = spark.createDataFrame([(c, *ab, c < "m045") for c, ab in want.items()], "cid string, a string, b string, old boolean")
    some = rows.join(known, "cid", "left").withColumn("fresh", ~F.coalesce("old", F.lit(False)))
    marked = some.withColumns({"a": F.when(~F.col("fresh"), F.lit("kept")), "b": F.when(~F.col("fresh"), F.col("b"))}).drop("old")
    got = {r["cid"]: (r["a"], r["b"]) for r in V._nearest(marked, 0.9, 8).collect()}
    assert got == {c: ("kept", ab[1]) if c < "m045" else ab for c, ab in want.items()}


def test_rounds_look_again_for_few_clusters(spark, monkeypatch):
    """After the first round only clusters that merged, or whose neighbour did, look for one; before, all did each round."""
    fresh, nearest = [], V._nearest

    def watched(rows, cut, block):
        fresh.append((rows.count(), rows.filter("fresh").count() if "fresh" in rows.columns else rows.count()))
        return nearest(rows, cut, block)

    monkeypatch.setattr(V, "_nearest", watched)
    points = cloud(6, 90)
    unit = V.with_unit_vectors(frame(spark, points))
    assert groups_of(V.average_linkage(unit, 0.35, block=16, small=0)) == greedy(points, 0.35)
    assert len(fresh) > 2 and sum(f for _, f in fresh[1:]) < 0.9 * sum(n for n, _ in fresh[1:])
