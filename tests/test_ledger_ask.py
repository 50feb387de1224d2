from datetime import datetime, timedelta

from pyspark.sql import functions as F

from earshot.operators import ask as A
from earshot.operators import ledger as G

T0 = datetime(2024, 1, 1)
RUN = (
    "local_seq long, run_id string, provider string, input_digest string, submitted_at timestamp, status string,"
    " provider_http_status int, n_results long, cost_usd double, billed_units long, cost_source string"
)
LIST = "run_id string, created_at timestamp, cost_usd double, billed_units long, status string, provider_http_status int, list_seq long"


def ledger(spark):
    return spark.createDataFrame(
        [
            (1, "r1", "apify", "d1", T0, "PENDING", None, 3, None, None, "unreconciled"),
            (2, "r2", "elevenlabs", "d2", T0, "COMPLETED", 200, 0, None, None, "unreconciled"),
            (3, None, "apify", "d1", T0 + timedelta(1), "LOCAL_REJECTED_429", None, 0, 0.0, None, "local"),
            (4, "r4", "apify", "d1", T0 + timedelta(2), "COMPLETED", None, 5, None, None, "unreconciled"),
            (5, "r5", "apify", "d9", T0, "COMPLETED", None, 5, None, None, "unreconciled"),
        ],
        RUN,
    )


def listing(spark):
    return spark.createDataFrame(
        [
            ("r1", T0, 0.5, 2, "COMPLETED", None, 1),
            ("r1", T0, 0.7, 3, "FAILED", 500, 2),  # repeated: the last one counts
            ("r2", None, 0.25, None, "", None, 3),
            ("r4", T0, None, 1, "COMPLETED", None, 4),  # unpriced
            ("r5", T0 - timedelta(hours=1), 9.0, 1, "COMPLETED", None, 5),  # before the session
            ("zz", T0 + timedelta(minutes=2), 1.0, 1, "COMPLETED", None, 6),
        ],
        LIST,
    )


def settled(spark):
    return G.reconcile(ledger(spark), listing(spark), T0, T0 + timedelta(days=1))


def test_reconcile(spark):
    rows, unmatched = settled(spark)
    got = {r["local_seq"]: (r["cost_usd"], r["billed_units"], r["status"], r["provider_http_status"], r["cost_source"]) for r in rows.collect()}
    assert got == {
        1: (0.7, 3, "FAILED", 500, "/v1/runs"), 2: (0.25, None, "COMPLETED", 200, "/v1/runs"),
        3: (0.0, None, "LOCAL_REJECTED_429", None, "local"), 4: (None, None, "COMPLETED", None, "unreconciled"),
        5: (None, None, "COMPLETED", None, "unreconciled"),
    }
    assert [r[0] for r in unmatched.collect()] == ["zz"]
    assert sorted(r[0] for r in G.unreconciled(rows).collect()) == [4, 5]


def test_totals_verdict_and_tampering(spark):
    rows, unmatched = settled(spark)
    t = G.totals(rows).first()
    assert (round(t["provider_usd"], 9), t["runs"], t["runs_billed"], t["runs_zero_results"], t["runs_failed"], t["voice_usd"]) == (0.95, 5, 2, 2, 2, 0.25)
    assert G.verdict(rows, unmatched).first()["verdict"] == "PARTIAL"
    fine = rows.filter("local_seq < 4")
    none = unmatched.limit(0)
    assert G.verdict(fine, none).first()["verdict"] == "RECONCILED"
    assert G.verdict(fine, none, replay=True).first()["verdict"] == "REPLAY"
    one = F.lit(1).alias("_one")
    stored = (
        G.totals(fine).select(one, "*").join(G.ledger_digest(fine).select(one, "content_digest"), "_one").drop("_one")
        .withColumns({"verdict": F.lit("RECONCILED"), "replay": F.lit(False)})
    )
    assert G.verify_receipt(stored, fine, none).first()["status"] == "ok"
    for spoil in ({"provider_usd": F.lit(1.0)}, {"verdict": F.lit("PARTIAL")}, {"content_digest": F.lit("x")}):
        assert G.verify_receipt(stored.withColumns(spoil), fine, none).first()["status"] == "invalid"
    assert G.ledger_violations(rows).count() == 0


def test_repeated_requests(spark):
    got = G.repeated_requests(ledger(spark)).collect()
    assert sorted((r["local_seq"], r["first_run_id"]) for r in got) == [(3, "r1"), (4, "r1")]


def test_unknown_model_is_an_error(spark):
    import pytest

    calls = spark.createDataFrame([("nope", 1, 0, 1)], "model string, tokens_in long, cached_in long, tokens_out long")
    with pytest.raises(Exception, match="no rate"):
        G.priced_calls(calls, G.model_rates(spark)).collect()


def test_comparison_without_cost(spark):
    row = G.comparison(spark.createDataFrame([(0.0,)], "total_usd double")).first()
    assert row["ratio"] is None


def numbers(spark, text, values, spoken=False):
    answers = spark.createDataFrame([("q", text)], "answer_id string, answer string")
    have = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(38,18)").alias("value"))
    return {r["number"]: r["verified"] for r in A.number_checks(answers, have, spoken=spoken).collect()}


def test_number_gate(spark):
    assert numbers(spark, "60% of 30, 0.60 and 29", ["0.6", "29.6"]) == {"60%": True, "30": False, "0.60": True, "29": False}
    assert numbers(spark, "34% or $1,234.50", ["0.336", "1234.5"]) == {"34%": True, "$1,234.50": True}
    assert numbers(spark, "0.13", ["0.125"]) == {"0.13": True}
    assert numbers(spark, "-3 vs 3", ["3"]) == {"-3": False, "3": True}
    assert numbers(spark, "no figures", ["3"]) == {}
    assert numbers(spark, "minus 0.27", ["-0.27"], spoken=True) == {"minus 0.27": True}


def test_check_answers(spark):
    answers = spark.createDataFrame(
        [("ok", "n is 5 [m1]", ["m1", " m1 ", ""]), ("bad", "n is 6 [ m9 ] .", ["m1", "m9"]), ("none", "nothing", [])],
        "answer_id string, answer string, citations array<string>",
    )
    known = spark.createDataFrame([("m1",), ("m2",)], "mention_id string")
    have = spark.createDataFrame([("5",)], "v string").select(F.col("v").cast("decimal(38,18)").alias("value"))
    got = {r["answer_id"]: r for r in A.check_answers(answers, known, have).collect()}
    assert (got["ok"]["status"], got["ok"]["citations_kept"]) == ("ok", ["m1"])
    assert (got["bad"]["status"], got["bad"]["citations_unknown"], got["bad"]["foreign_numbers"]) == ("unverified", ["m9"], ["6"])
    assert got["bad"]["answer"] == "n is 6."
    assert got["none"]["status"] == "ok"


def test_lexical_ranking_and_fallback(spark):
    rows = [("m1", "the red card", 5), ("m2", "red red red", 9), ("m3", "the card is red", 1), ("m4", None, 7)]
    df = spark.createDataFrame(rows, "mention_id string, text string, engagement_score long")
    got, method = A.retrieve(df, "Red card, the", None, 3)
    assert method == "lexical" and [r["mention_id"] for r in got.collect()] == ["m1", "m3", "m2"]


def test_numbers_with_many_places_are_told_apart(spark):
    from pyspark.sql import functions as F

    from earshot.operators import ask

    rows = [(1, "it was 0.12345678901"), (2, "it was 0.12345678902"), (3, "it was 12.345678902%"), (4, "it was 0.1234567890212345678901")]
    answers = spark.createDataFrame(rows, "answer_id long, answer string")
    have = spark.createDataFrame([("0.12345678902",)], "v string").select(F.col("v").cast("decimal(38,18)").alias("value"))
    got = {r.answer_id: r.verified for r in ask.number_checks(answers, have).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_numbers_meet_known_values_once(spark):
    """One exchange for the known values, one for the numbers, one for the result."""
    answers = spark.createDataFrame([("q", "a", "up 12.5% to 3.14"), ("r", "b", "up 12.5% to 3.14, or 3.14")], "answer_id string, brand string, answer string")
    have = spark.createDataFrame([("a", "0.1249"), ("a", "3.1415"), ("b", "3.2"), ("b", None)], "brand string, value string")
    got = A.number_checks(answers, have, ["brand"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    assert {(r.answer_id, r.position, r.number): r.verified for r in got.collect()} == {
        ("q", 0, "12.5%"): True, ("q", 1, "3.14"): True, ("r", 0, "12.5%"): False, ("r", 1, "3.14"): False,
    }


def test_numbers_of_any_length(spark):
    known = "1234567890123456789.0123456789012345678901234"
    true = ["1,234,567,890,123,456,789.0123456789012345678901234", "1234567890123456789.01234567890123456789012340", "1234567890123456789.012346", "1234567890123456789.0"]
    false = ["1234567890123456789.0123456789012345678901235", "1234567890123456789.012345", "1234567890123456789", "-1234567890123456789.0"]
    got = numbers_of(spark, " and ".join(true + false), [known])
    assert {n: got[n] for n in true + false} == {**dict.fromkeys(true, True), **dict.fromkeys(false, False)}
    assert numbers_of(spark, "0.1234567890123456789012345 or 12.34567890123456789012345%", ["0.1234567890123456789012345"]) == {
        "0.1234567890123456789012345": True, "12.34567890123456789012345%": True,
    }
    # Carries, halves, signs and zeros.
    assert numbers_of(spark, "10.0 or 9.99 or 9.9", ["9.995"]) == {"10.0": True, "9.99": False, "9.9": False}
    assert numbers_of(spark, "-0.3 or -0.2 or 0.0", ["-0.25", "-0.04"]) == {"-0.3": True, "-0.2": False, "0.0": True}
    assert numbers_of(spark, "0.00% or 100%", ["1", "0.00001"]) == {"0.00%": True, "100%": True}


def numbers_of(spark, text, values):
    answers = spark.createDataFrame([("q", text)], "answer_id string, answer string")
    have = spark.createDataFrame([(v,) for v in values], "value string")
    return {r["number"]: r["verified"] for r in A.number_checks(answers, have).collect()}


def test_plain_form_of_numbers(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from earshot.functions import numbers as N

    texts = ["0", "-0.0", "007.50", "1e3", "1.25E-7", "-12.5e+2", "+.5", "9.", "1e-30", "12.34e1", "x", "", None, "NaN", "1e99999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["0", "0", "7.5", "1000", "0.000000125", "-1250", "0.5", "9", "0." + "0" * 29 + "1", "123.4", None, None, None, None, None]
    assert [r[0] for r in df.select(N.number_text("t")).collect()] == want
    doubles = spark.createDataFrame([(1e22,), (0.1,), (-3.0,), (1.5e-9,)], "v double").select(N.number_text("v"))
    assert [r[0] for r in doubles.collect()] == ["10000000000000000000000", "0.1", "-3", "0.0000000015"]
    rng = __import__("random").Random(2)
    rows = [(f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randrange(1, 9))}.{''.join(rng.choice('0459') for _ in range(rng.randrange(1, 12)))}", rng.randrange(0, 9)) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string, p int").select(N.rounded(N.number_text("t"), F.col("p")), N.hundredth(N.number_text("t"))).collect()
    for (text, places), (rounded, hundredth) in zip(rows, got):
        value = Decimal(text)
        exact = value if -value.as_tuple().exponent <= places else value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
        assert Decimal(rounded) == exact and Decimal(hundredth) == value / 100
        assert rounded == "0" or not (rounded.endswith("0") and "." in rounded)


def test_numbers_of_nested_records(spark):
    record = (
        "a", "9", 3, True, [{"share": 0.25, "run_id": "41", "notes": ["up 12 per cent on 2024-01-05", "x7"], "by_day": {"mon": 1.5e-7}}], None,
    )
    schema = "brand string, run_id string, n int, live boolean, topics array<struct<share: double, run_id: string, notes: array<string>, by_day: map<string, double>>>, empty string"
    records = spark.createDataFrame([record, ("b", "1", -4, False, [], "of $1,234.50")], schema)
    got = {(r["brand"], r["value"]) for r in A.available_from_records(records, ["brand"]).collect()}
    assert got == {("a", "3"), ("a", "0.25"), ("a", "12"), ("a", "0.00000015"), ("b", "-4"), ("b", "1234.5")}
    paths = {(r["path"], r["key"]) for r in A.record_leaves(records.filter("brand = 'a'"), ["brand"]).collect()}
    assert (".topics[0].notes[1]", "notes") in paths and (".topics[0].by_day.mon", "mon") in paths
    parsed = records.select("brand", F.parse_json(F.lit('{"deep": [[{"x": [1, {"url": "8", "y": "2"}]}]]}')).alias("v"))
    assert {r["value"] for r in A.available_from_records(parsed, ["brand"]).collect()} == {"1", "2"}


def test_repeated_requests_of_a_hot_digest(spark):
    rows = [(i, "hot" if i % 3 else f"d{i}", None if i == 1 else f"r{i}", i) for i in range(300)] + [(999, None, "r", 1)]
    log = spark.createDataFrame(rows, "local_seq long, input_digest string, run_id string, at long").withColumn("submitted_at", F.timestamp_seconds("at")).drop("at")
    got = G.repeated_requests(log).collect()
    assert sorted(r["local_seq"] for r in got) == [i for i in range(300) if i % 3 and i > 2] and {r["first_run_id"] for r in got} == {"r2"}
    plan = G.repeated_requests(log)._jdf.queryExecution().executedPlan().toString()
    assert "_hash" in plan or "_of" in plan
