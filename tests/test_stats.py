import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import scalars as S
from earshot.operators import bootstrap as B
from earshot.operators import events as E
from earshot.operators import frame as R
from earshot.operators import verdicts
from earshot.operators.quality import estimate_violations
from earshot.plans.stats import StatsPlan

NOW = datetime(2024, 3, 15, 12)
ROW = (
    "mention_id string, brand string, source string, cluster_key string, published_at timestamp,"
    " engagement_score long, url string, matched_terms array<string>, label string, about_brand boolean,"
    " corroboration string, status string, topic_id string"
)


def rows(spark, seed=3):
    """Two healthy brands, one thin brand; some undated, irrelevant and failed rows."""
    rng, out = random.Random(seed), []
    for brand, clusters in (("a", 12), ("b", 9), ("c", 2)):
        for k in range(clusters):
            for j in range(rng.randint(3, 6)):
                i = len(out)
                at = None if i % 17 == 0 else NOW - timedelta(days=rng.uniform(0.1, 13.9))
                label = rng.choice(["positive", "negative", "neutral", "positive"])
                out.append((
                    f"{i:04d}", brand, ("reddit", "news", "g2")[i % 3], f"k{k}", at, rng.randint(0, 9), f"u{i}",
                    ["x"] if i % 19 else [], "irrelevant" if i % 23 == 0 else label, i % 29 != 0,
                    "confirmed" if i % 2 else "model_only", "error" if i % 31 == 0 else "ok", None,
                ))
    return spark.createDataFrame(out, ROW)


@pytest.fixture(scope="module")
def plan(spark):
    return StatsPlan(rows(spark), R.brand_table(spark, ["a", "b", "c"]), ["reddit", "news"], NOW, b=60)


def brute(df):
    return [r for r in df.collect() if r["status"] in ("ok", "cached") and r["about_brand"] and r["matched_terms"]]


def test_points_against_plain_python(spark, plan):
    kept = brute(rows(spark))
    shares = {r["brand"]: r for r in plan.share_points().collect()}
    in_basis = [r for r in kept if r["source"] in ("reddit", "news")]
    for brand in "abc":
        mine = [r for r in in_basis if r["brand"] == brand]
        assert shares[brand]["n"] == len(mine)
        assert shares[brand]["n_clusters"] == len({r["cluster_key"] for r in mine})
        if shares[brand]["share"] is not None:
            # A brand below the minimums stays in the denominator.
            assert math.isclose(shares[brand]["share"], len(mine) / len(in_basis))
    assert shares["c"]["share"] is None and "n=" in shares["c"]["level_detail"]
    nets = {r["brand"]: r for r in plan.net_points().collect()}
    for brand in "abc":
        labels = [r["label"] for r in kept if r["brand"] == brand]
        assert (nets[brand]["pos"], nets[brand]["neg"], nets[brand]["neu"]) == tuple(
            labels.count(p) for p in ("positive", "negative", "neutral")
        )


@pytest.mark.parametrize("method", ["counter", "multinomial"])
def test_every_iteration_draws_all_units(spark, plan, method):
    kinds = B.unit_kinds(plan.cells.withColumn("n", F.lit(1).cast("long")).dropDuplicates(["brand", "cluster_key"]))
    n = plan.cells.select("brand", "cluster_key").distinct().count()
    drawn = B.resample(kinds, b=40, method=method).groupBy("b").agg(F.sum("w").alias("w")).collect()
    # Each unit carries one row here, so the drawn weights of an iteration sum to the unit count.
    assert len(drawn) == 40 and {r["w"] for r in drawn} == {n}


def test_draws_do_not_depend_on_partitions(spark, plan):
    for method in ("counter", "multinomial"):
        kinds = B.row_kinds(plan.cells)
        once = sorted(map(tuple, B.resample(kinds, b=7, method=method).collect()), key=str)
        again = sorted(map(tuple, B.resample(kinds.repartition(13), b=7, method=method).collect()), key=str)
        assert once == again


def test_both_methods_have_the_same_law(spark, plan):
    """Mean and spread of the share draws agree with the exact moments of the unit bootstrap."""
    kept = [r for r in brute(rows(spark)) if r["source"] in ("reddit", "news") or True]
    units = {}
    for r in kept:
        units.setdefault((r["brand"], r["cluster_key"]), 0)
        units[(r["brand"], r["cluster_key"])] += r["brand"] == "a"
    x = np.array(list(units.values()), dtype=float)
    n = len(x)
    for method in ("counter", "multinomial"):
        d = B.resample(B.unit_kinds(plan.cells), b=1500, method=method)
        w = [r["w"] for r in d.filter("key = 'a'").groupBy("b").agg(F.sum("w").alias("w")).collect()]
        assert abs(np.mean(w) - x.sum()) < 4 * math.sqrt(n * x.var() / 1500)
        assert abs(np.var(w) / (n * x.var()) - 1) < 0.2


def test_intervals_and_verdicts_hang_together(plan):
    shares = plan.share_draws().groupBy("b").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in shares)
    sov = {r["brand"]: r for r in plan.share_of_voice().collect()}
    assert all(r["ci_lo"] <= r["share"] <= r["ci_hi"] for r in sov.values() if r["share"] is not None)
    assert sov["c"]["wow"]["verdict"] == "ABSTAIN" and sov["c"]["wow"]["delta"] is None
    sent = plan.sentiment()
    assert estimate_violations(sent, ["brand"]).count() == 0
    assert estimate_violations(plan.by_source(), ["brand", "source"]).count() == 0
    reasons = {(r["brand"], r["reason"]) for r in plan.abstentions().collect()}
    assert ("c", "below_minimum") in reasons
    assert plan.by_source().count() == 6


def test_empty_frame(spark):
    none = StatsPlan(rows(spark).limit(0), R.brand_table(spark, ["a"]), ["reddit"], NOW, b=5)
    row = none.share_of_voice().first()
    assert row["n"] == 0 and row["share"] is None and row["wow"]["verdict"] == "ABSTAIN"
    assert none.events().count() == 0


def test_holm_by_hand(spark):
    ps = [0.01, None, 0.04, 0.03, 0.01]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "position int, p_raw double")
    got = [r["p_holm"] for r in verdicts.holm(df).orderBy("position").collect()]
    assert got[1] is None
    assert [round(got[i], 10) for i in (0, 4, 3, 2)] == [0.04, 0.04, 0.06, 0.06]


def test_verdict_ladder(spark):
    cases = [
        (0.1, 0.05, 0.2, -0.3, -0.1, 0.001, 0.002, False, "ABSTAIN"),
        (0.1, 0.05, 0.2, 0.01, 0.3, 0.001, 0.002, False, "SIGNIFICANT"),
        (0.1, 0.05, 0.2, -0.1, 0.3, 0.001, 0.002, False, "SUGGESTIVE"),
        (0.1, 0.05, 0.2, None, None, 0.001, 0.002, False, "SUGGESTIVE"),
        (0.1, 0.05, 0.2, None, None, 0.001, 0.002, True, "SIGNIFICANT"),
        (0.1, -0.05, 0.2, None, None, 0.2, 0.4, True, "NO_CHANGE_DETECTED"),
    ]
    df = spark.createDataFrame(cases, "d double, lo double, hi double, cl double, ch double, p double, h double, s boolean, want string")
    got = df.select("want", S.wow_verdict("d", "lo", "hi", "cl", "ch", "p", "h", "s").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_two_sided_p_and_percentile(spark):
    draws = [-1.0, 0.0, 1.0, 2.0, None, 3.0]
    df = spark.createDataFrame([(d,) for d in draws], "d double")
    row = df.agg(B.two_sided_p("d").alias("p"), B.percentile_interval("d").alias("ci")).first()
    assert math.isclose(row["p"], 0.8)
    assert np.allclose(row["ci"], np.percentile([-1, 0, 1, 2, 3], [2.5, 97.5]))


def test_events_leave_the_tested_day_out(spark):
    out = []
    for day in range(14):
        for j in range(12 if day == 13 else (2 if day % 2 else 1)):
            at = datetime(2024, 3, 2) + timedelta(days=day, hours=j)
            out.append((f"{day:02d}{j:02d}", "a", "news", f"k{j}", at, j, f"u{day}-{j}", ["nu bank"], "positive", True, "confirmed", "ok", f"t{j % 2}"))
    df = R.stats_rows(spark.createDataFrame(out, ROW), NOW)
    brands = R.brand_table(spark, ["a", "quiet"])
    names = spark.createDataFrame([("t0", "Card limits raised again and again today")], "topic_id string, name string")
    got = E.detect_events(df, brands, NOW, names).collect()
    assert [(str(r["date"]), r["n"], r["baseline_median"], r["baseline_mad"], r["threshold"]) for r in got] == [
        ("2024-03-15", 12, 1.0, 0.0, 5.0)
    ]
    assert got[0]["label"] == "Card limits raised again and again" and got[0]["exhibit_url"] == "u13-11"
    assert E.filled_days(df, brands, NOW).count() == 28
    assert E.detect_events(df, brands, NOW).first()["label"] == "nu bank"


def test_rows_of_a_brand_are_not_exchanged_into_one_task(plan):
    steps = plan.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in steps and "SortMergeJoin" not in steps


def test_verdicts_draw_no_single_rows(spark, monkeypatch):
    """Verdicts and share of voice read the draws of clusters; single rows cost most draws."""
    fresh = StatsPlan(rows(spark), R.brand_table(spark, ["a", "b", "c"]), ["reddit", "news"], NOW, b=20)
    monkeypatch.setattr(fresh, "iid_draws", lambda: pytest.fail("rows were drawn"))
    assert fresh.tests().count() == 6 and fresh.share_of_voice().count() == 3
    fresh.close()
