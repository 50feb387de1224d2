import itertools
import math

from earshot.operators import labels as L
from earshot.operators.quality import label_violations
from pyspark.sql import functions as F

POLAR = ("positive", "negative", "neutral")
OBS = "mention_id string, brand string, status string, label string, about_brand boolean, confidence double, rationale string"


def expected(label, confidence, signal, answer):
    """The precedence, restated: agreement, tiebreak, overflow, otherwise the model alone."""
    if signal is not None and signal == label:
        return label, "confirmed", "classifier", False
    triggered = signal is not None or confidence < 0.6
    if not triggered:
        return label, "model_only", "classifier", False
    if answer is None:
        return label, "model_only", "classifier", True
    status, other, about = answer
    if status != "ok" or not about or other not in POLAR:
        return label, "model_only", "classifier", False
    if other == label:
        return label, "confirmed", "classifier", False
    return other, "contested", "tiebreak", False


def test_decision_matrix(spark):
    answers = [None, ("error", "positive", True), ("ok", "irrelevant", True), ("ok", "positive", False)]
    answers += [("ok", p, True) for p in POLAR]
    cases = list(itertools.product(POLAR, (0.5, 0.6, 0.9), (None, *POLAR), answers))
    rows = [
        (i, label, conf, (None, s), "r", *((a[0], a[1], a[2], 0.7, "t") if a else (None,) * 5))
        for i, (label, conf, s, a) in enumerate(cases)
    ]
    schema = (
        "i int, c_label string, c_confidence double, signal struct<kind:string,label:string>, c_rationale string,"
        " t_status string, t_label string, t_about_brand boolean, t_confidence double, t_rationale string"
    )
    got = spark.createDataFrame(rows, schema).select("i", L.corroborate().alias("d")).orderBy("i").collect()
    for row, (label, conf, s, a) in zip(got, cases):
        d = row["d"]
        assert (d["label"], d["corroboration"], d["decided_by"], d["overflow"]) == expected(label, conf, s, a)
        assert d["confidence"] == (0.7 if d["decided_by"] == "tiebreak" else conf)


def session(spark, n=60):
    mentions = spark.createDataFrame(
        [(f"{i:024x}", "b", "reddit", "good" if i % 2 else "nothing", None, None if i % 5 == 0 else i, ["b"] if i % 11 else [])
         for i in range(n)],
        "mention_id string, brand string, source string, text string, rating int, at int, matched_terms array<string>",
    ).withColumn("published_at", F.timestamp_seconds(F.col("at") * 3600)).drop("at")
    obs = spark.createDataFrame(
        [(f"{i:024x}", "b", "refused" if i % 13 == 0 else "ok", POLAR[i % 3], i % 7 != 0, 0.5 + (i % 5) / 10, "why") for i in range(n)], OBS
    )
    ties = spark.createDataFrame([(f"{i:024x}", "b", "ok", POLAR[(i + i // 3) % 3], True, 0.8, "again") for i in range(n)], OBS)
    return mentions, obs, ties


def test_whole_policy_obeys_caps_and_rules(spark):
    mentions, obs, ties = session(spark)
    got = L.label_mentions(mentions, obs, ties)
    rows = got.collect()
    assert len(rows) == 60
    policy = [r for r in rows if r["status"] in ("ok", "cached") and r["corroboration"] != "irrelevant"]
    called = [r for r in policy if r["signals"]["tiebreak"] is not None]
    assert len(called) <= math.floor(0.4 * len(policy))
    assert sum(r["audited"] for r in rows) == math.floor(0.1 * len(policy))
    assert all(r["signals"]["tiebreak"] is not None for r in rows if r["audited"])
    assert any(r["signals"]["overflow"] for r in rows)
    usage = F.struct(F.lit(0).alias("tokens"), F.lit(0.0).alias("cost_usd"))
    assert label_violations(got.filter("label is not null").withColumn("usage", usage)).count() == 0
    summary = L.audit(got).first()
    assert summary["tiebreak_calls"] == len(called)


def test_empty_session(spark):
    mentions, obs, ties = session(spark)
    none = L.label_mentions(mentions.limit(0), obs, ties)
    assert none.count() == 0
    assert L.audit(none).first()["agreement"] is None


def test_align_first_answer_wins(spark):
    asked = spark.createDataFrame([("m1", "b"), ("m2", "b")], "mention_id string, brand string")
    answers = spark.createDataFrame(
        [("m1", "b", 2, "late"), ("m1", "b", 1, "first"), ("zz", "b", 3, "other")],
        "mention_id string, brand string, position int, label string",
    ).withColumn("rationale", F.lit("r"))
    got = {r["mention_id"]: (r["status"], r["label"], r["rationale"]) for r in L.align_answers(asked, answers).collect()}
    assert got == {"m1": ("ok", "first", "r"), "m2": ("unparseable", None, "id missing from answer")}


def test_apportioned_tokens_sum_exactly(spark):
    items = spark.createDataFrame([("b", 0, i) for i in range(7)], "brand string, batch long, in_batch long")
    calls = spark.createDataFrame([("b", 0, 100, 0.7)], "brand string, batch long, tokens long, cost_usd double")
    got = L.apportion(items, calls).orderBy("in_batch").collect()
    assert [r["tokens"] for r in got] == [15, 15, 14, 14, 14, 14, 14]
    assert abs(sum(r["cost_usd"] for r in got) - 0.7) < 1e-12
