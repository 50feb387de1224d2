import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.operators import dedup as D
from earshot.operators import sampling
from earshot.operators.ranking import bucketed_rank, bucketed_running_total, keep_last, top_per_group


def test_bucketed_rank_equals_row_number(spark):
    rng = random.Random(1)
    # A third of all rows share one group, and ties are broken by the second column.
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 5)}", rng.randint(0, 30), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    order = [F.col("v"), F.col("i")]
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = bucketed_rank(want, ["g"], [F.floor(F.col("v") / 4)], order, "r")
    assert got.filter("r <> w").count() == 0 and got.count() == 2000


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(300)], "i int, m long")
    got = bucketed_running_total(df, [F.floor(F.col("i") / 7)], [F.col("i")], "m", "lo")
    total = 0
    for row in got.orderBy("i").collect():
        assert row["lo"] == total
        total += row["m"]


def test_keep_last_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, None)], "k string, o int, v string")
    assert sorted(map(tuple, keep_last(df, ["k"], ["o"]).collect())) == [("a", 3, "z"), ("b", 2, None)]
    top = top_per_group(df, ["k"], [F.desc("o")], 1)
    assert sorted(r["o"] for r in top.collect()) == [2, 3]


ITEM = "source string, brand string, native_id string, url string, text string, raw_ref string"


def test_dedup_rules_and_winners(spark):
    rows = [
        ("reddit", "a", "n1", None, "t", "2#0"), ("reddit", "a", "n1", "u", "t", "1#9"),
        ("reddit", "a", "n1", None, "t", "10#0"), ("reddit", "b", "n1", None, "t", "3#0"),
        ("news", "a", "n1", None, "t", "4#0"),
        ("news", "a", None, "http://h/x?utm_source=1", "t", "5#0"), ("news", "a", None, "HTTP://H/x/", "q", "5#1"),
        ("news", "a", None, None, "Hello  World", "6#10"), ("news", "a", None, None, "hello world @me", "6#2"),
    ]
    got = {r["raw_ref"]: (r["reason"], r["winner_ref"]) for r in D.dedup(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {
        "2#0": ("dedup_native_id", "1#9"), "1#9": (None, "1#9"), "10#0": ("dedup_native_id", "1#9"),
        "3#0": (None, "3#0"), "4#0": (None, "4#0"), "5#0": (None, "5#0"), "5#1": ("dedup_url", "5#0"),
        "6#10": ("dedup_text", "6#2"), "6#2": (None, "6#2"),
    }


def test_dedup_is_whole_under_skew_and_on_nothing(spark):
    assert D.dedup(spark.createDataFrame([], ITEM)).count() == 0
    rows = [("news", "a", None, None, "same" if i % 3 == 0 else f"t{i}", f"{i}#0") for i in range(900)]
    done = D.dedup(spark.createDataFrame(rows, ITEM))
    assert D.kept(done).count() == 601 and D.dropped(done).count() == 299


def test_stratified_sample_sizes(spark):
    rows = [(f"m{i}", "big" if i < 90 else f"s{i % 4}") for i in range(130)]
    df = spark.createDataFrame(rows, "mention_id string, source string")
    slots = {r["source"]: r["slots"] for r in sampling.allocation(df, "source", "source", 50).collect()}
    assert sum(slots.values()) == 50 and slots["big"] in (34, 35)
    assert sampling.stratified_sample(df, "source", "source").count() == 50
    few = df.limit(20)
    assert sampling.stratified_sample(few, "source", "source").count() == 20


def test_range_buckets_agree_with_the_order_and_are_even(spark):
    from earshot.operators.ranking import range_bucket

    rows = [(f"t3_{i * 7919 % 100_003:06d}",) for i in range(5000)] + [(None,)]
    df = spark.createDataFrame(rows, "k string")
    got = df.withColumn("b", range_bucket(df, "k")).collect()
    order = sorted((r.k, r.b) for r in got if r.k is not None)
    assert [b for _, b in order] == sorted(b for _, b in order)
    sizes = {}
    for _, b in order:
        sizes[b] = sizes.get(b, 0) + 1
    assert len(sizes) > 100 and max(sizes.values()) < 5000 / 40


def test_winners_have_an_exchange_of_their_own(spark):
    from earshot.operators import dedup

    rows = [("reddit", "a", "same" if i % 2 else f"n{i}", None, "text", f"1#{i}") for i in range(200)]
    items = spark.createDataFrame(rows, "source string, brand string, native_id string, url string, text string, raw_ref string")
    got = dedup.dedup(items)
    assert got.columns == [*items.columns, "reason", "winner_ref"]
    kept = [r for r in got.collect() if r.reason is None]
    assert len(kept) == 101 and sum(r.native_id == "same" for r in kept) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_key_hash" in plan
