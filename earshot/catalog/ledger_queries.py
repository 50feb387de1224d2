"""Cost queries: lineitem as the run log, orders as the billing list."""

from pyspark.sql import functions as F

from earshot import config
from earshot.catalog import label_queries as LQ
from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.functions import scalars as S
from earshot.operators import counts as C
from earshot.operators import labels as L
from earshot.operators import ledger as G
from earshot.sources import tables as T

LEDGER = V.with_("log", "ledger")
SETTLED = V.with_("log", "ledger", "list")


def ledger(spark, sf_dir):
    return G.fold_log(V.runs_log(spark, sf_dir))


def settled(spark, sf_dir):
    return G.reconcile(
        ledger(spark, sf_dir), V.runs_list(spark, sf_dir), V.STARTED, V.RECONCILED
    )


@query(
    "w02_ledger_fold",
    LEDGER + "SELECT local_seq, run_id, input_digest, status, n_results, cost_source FROM ledger",
)
def ledger_fold(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "local_seq", "run_id", "input_digest", "status", "n_results", "cost_source"
    )


@query(
    "src16_ledger_log",
    LEDGER + "SELECT status, cost_source, count(*) AS n FROM ledger GROUP BY ALL",
)
def ledger_log(spark, sf_dir):
    """Appended in two batches, the last state of each run in the later one, and read back."""
    path = T.fresh_path(spark, "log")
    T.write_log(V.runs_log(spark, sf_dir), path, 0)
    T.write_log(ledger(spark, sf_dir), path, 1)
    # All lines are folded; of each only what is counted is exchanged.
    lines = T.read_log(spark, path).select("local_seq", "write_seq", "status", "cost_source")
    return G.fold_log(lines).groupBy("status", "cost_source").agg(F.count(F.lit(1)).alias("n"))


@query("p09_listing_window", SETTLED + "SELECT run_id FROM inwin")
def listing_window(spark, sf_dir):
    return G.in_window(V.runs_list(spark, sf_dir), V.STARTED, V.RECONCILED).select("run_id")


@query(
    "j06_reconcile",
    SETTLED + """SELECT local_seq, round(cost_usd, 9) AS cost_usd, billed_units, status, http,
  cost_source FROM settled""",
)
def reconcile(spark, sf_dir):
    rows, _ = settled(spark, sf_dir)
    return rows.select(
        "local_seq", F.round("cost_usd", 9).alias("cost_usd"), "billed_units", "status",
        F.col("provider_http_status").alias("http"), "cost_source",
    )


@query(
    "j06_unmatched_remote",
    SETTLED + "SELECT DISTINCT run_id FROM inwin WHERE run_id NOT IN (SELECT run_id FROM ledger"
    " WHERE run_id IS NOT NULL)",
)
def unmatched_remote(spark, sf_dir):
    return settled(spark, sf_dir)[1]


@query(
    "a12_unreconciled",
    SETTLED + "SELECT local_seq FROM settled WHERE cost_source = 'unreconciled'",
)
def unreconciled(spark, sf_dir):
    return G.unreconciled(settled(spark, sf_dir)[0])


@query(
    "a12_reconciliation_summary",
    SETTLED + """SELECT (SELECT count(DISTINCT run_id) FROM inwin) AS n_listed_in_window,
  (SELECT count(DISTINCT run_id) FROM inwin WHERE run_id NOT IN (SELECT run_id FROM ledger
    WHERE run_id IS NOT NULL)) AS n_unmatched_remote,
  (SELECT count(*) FROM settled WHERE cost_source = 'unreconciled') AS n_unreconciled""",
)
def reconciliation_summary(spark, sf_dir):
    rows, unmatched = settled(spark, sf_dir)
    listed = G.in_window(V.runs_list(spark, sf_dir), V.STARTED, V.RECONCILED)
    return G.reconciliation_summary(rows, listed, unmatched)


TOTALS = SETTLED + """, tot AS (SELECT
  coalesce(sum(cost_usd) FILTER (cost_source = '/v1/runs'), 0) AS provider_usd,
  count(*) AS runs, count(*) FILTER (cost_usd > 0) AS runs_billed,
  count(*) FILTER (n_results = 0) AS runs_zero_results,
  count(*) FILTER (status LIKE 'LOCAL\\_%' ESCAPE '\\' OR status = 'FAILED') AS runs_failed,
  coalesce(sum(cost_usd) FILTER (cost_source = '/v1/runs' AND provider = 'elevenlabs'), 0) AS voice_usd
  FROM settled)"""


@query(
    "a11_totals",
    TOTALS + """SELECT round(provider_usd, 6) AS provider_usd, runs, runs_billed, runs_zero_results,
  runs_failed, round(voice_usd, 6) AS voice_usd FROM tot""",
)
def totals(spark, sf_dir):
    got = G.totals(settled(spark, sf_dir)[0])
    return got.withColumns({c: F.round(c, 6) for c in ("provider_usd", "voice_usd")})


@query(
    "f31_failed_runs",
    LEDGER + "SELECT status, status LIKE 'LOCAL%' OR status = 'FAILED' AS failed, count(*) AS n"
    " FROM log GROUP BY ALL",
)
def failed_runs(spark, sf_dir):
    log = V.runs_log(spark, sf_dir)
    return log.groupBy("status", S.is_failed("status").alias("failed")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f29_receipt_verdict",
    SETTLED + """SELECT CASE WHEN bool_and(cost_source = '/v1/runs' OR run_id IS NULL) AND
    (SELECT count(*) FROM inwin WHERE run_id LIKE 'x%') = 0 THEN 'RECONCILED' ELSE 'PARTIAL' END
  AS verdict, bool_and(cost_source = '/v1/runs' OR run_id IS NULL) AS all_reconciled,
  (SELECT count(DISTINCT run_id) FROM inwin WHERE run_id NOT IN (SELECT run_id FROM ledger
    WHERE run_id IS NOT NULL)) AS n_unmatched FROM settled""",
)
def receipt_verdict(spark, sf_dir):
    return G.verdict(*settled(spark, sf_dir))


@query(
    "f30_abstain_reason",
    """WITH t AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'TIMED_OUT' WHEN 1 THEN 'LOCAL_REJECTED_429'
    WHEN 2 THEN 'LOCAL_REJECTED_402' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'LOCAL_DEADLINE'
    ELSE 'COMPLETED' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 503 ELSE 200 END AS http FROM orders)
SELECT coalesce(CASE WHEN status IN ('TIMED_OUT', 'LOCAL_DEADLINE') THEN 'deadline'
  WHEN status = 'LOCAL_REJECTED_429' THEN 'rate_limited' WHEN status = 'LOCAL_REJECTED_402' THEN 'halted'
  WHEN status = 'FAILED' OR http >= 400 THEN 'provider_failed' END, 'none') AS reason, count(*) AS n
FROM t GROUP BY ALL""",
)
def abstain_reason(spark, sf_dir):
    k = F.col("o_orderkey")
    states = (
        "TIMED_OUT", "LOCAL_REJECTED_429", "LOCAL_REJECTED_402", "FAILED", "LOCAL_DEADLINE", "COMPLETED",
    )
    o = V.table(spark, sf_dir, "orders").select(
        V._cycle(k % 6, states).alias("status"), F.when(k % 4 == 0, 503).otherwise(200).alias("http")
    )
    reason = F.coalesce(S.abstain_reason("status", "http"), F.lit("none")).alias("reason")
    return o.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f32_parse_timestamp",
    """SELECT o_orderkey, epoch(o_orderdate)::BIGINT + CASE WHEN o_orderkey % 4 = 3 THEN 3600 ELSE 0 END
  AS at FROM orders""",
)
def parse_timestamp(spark, sf_dir):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    seconds = F.unix_timestamp(at)
    text = (
        F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 4 == 1, seconds.cast("string"))
        .when(k % 4 == 2, (seconds * 1000).cast("string"))
        .otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-01:00")))
    )
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.unix_timestamp(S.parse_timestamp(text)).alias("at"))


@query(
    "j16_repeated_requests",
    LEDGER + """, f AS (SELECT input_digest, min((submitted_at, local_seq)) AS fst,
    arg_min(run_id, (submitted_at, local_seq)) AS first_run_id
  FROM ledger WHERE run_id IS NOT NULL GROUP BY ALL)
SELECT local_seq, input_digest, first_run_id FROM ledger JOIN f USING (input_digest)
WHERE (submitted_at, local_seq) > fst""",
)
def repeated_requests(spark, sf_dir):
    return G.repeated_requests(ledger(spark, sf_dir)).select(
        "local_seq", "input_digest", "first_run_id"
    )


_CALLS = """calls AS (SELECT l_orderkey, CASE l_suppkey % 3 WHEN 0 THEN 'gpt-5.6-luna'
    WHEN 1 THEN 'gpt-5.6-terra' ELSE 'text-embedding-3-small' END AS model,
  CASE l_linenumber % 6 WHEN 0 THEN 'classify' WHEN 1 THEN 'tiebreak' WHEN 2 THEN 'embed'
    WHEN 3 THEN 'name_topic' WHEN 4 THEN 'narrate' ELSE 'ask' END AS kind,
  l_partkey AS tin, l_partkey // 3 AS cin, l_quantity::BIGINT AS tout FROM lineitem),
priced AS (SELECT *, ((tin - cin) * r.i + cin * r.i + tout * r.o) / 1000000.0 AS usd
  FROM calls JOIN (VALUES ('gpt-5.6-luna', 0.2::DOUBLE, 1.2::DOUBLE), ('gpt-5.6-terra', 2.0::DOUBLE,
    12.0::DOUBLE), ('text-embedding-3-small', 0.02::DOUBLE, 0.0::DOUBLE)) r(model, i, o) USING (model))"""


def _calls(spark, sf_dir):
    models = ("gpt-5.6-luna", "gpt-5.6-terra", "text-embedding-3-small")
    kinds = config.LLM_KINDS
    calls = V.table(spark, sf_dir, "lineitem").select(
        V._cycle(F.col("l_suppkey") % 3, models).alias("model"),
        V._cycle(F.col("l_linenumber") % 6, kinds).alias("kind"),
        F.col("l_partkey").alias("tokens_in"),
        F.floor(F.col("l_partkey") / 3).alias("cached_in"),
        F.col("l_quantity").cast("long").alias("tokens_out"),
    )
    return G.priced_calls(calls, G.model_rates(spark))


@query(
    "f21_priced_usage",
    f"WITH {_CALLS} SELECT model, count(*) AS n, round(sum(usd), 6) AS usd FROM priced GROUP BY model",
)
def priced_usage(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("usd")
    )


@query(
    "a13_llm_usage",
    f"""WITH {_CALLS} SELECT kind, count(*) AS calls, sum(tin + tout)::BIGINT AS tokens,
  round(sum(usd), 6) AS usd FROM priced GROUP BY kind""",
)
def llm_usage(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumns(
        {"calls": F.lit(1).cast("long"), "tokens": F.col("tokens_in") + F.col("tokens_out")}
    )
    return G.llm_usage(calls).withColumn("usd", F.round("usd", 6))


@query(
    "a14_comparison",
    TOTALS + """SELECT round(provider_usd * 4, 6) AS usd_month_equiv,
  round(349 / (provider_usd * 4), 6) AS ratio FROM tot""",
)
def comparison(spark, sf_dir):
    got = G.totals(settled(spark, sf_dir)[0]).withColumn("total_usd", F.col("provider_usd"))
    return G.comparison(got).select(
        F.round("usd_month_equiv", 6).alias("usd_month_equiv"), F.round("ratio", 6).alias("ratio")
    )


@query(
    "a17_session_spend",
    """WITH s AS (SELECT 's' || (o_custkey % 50) AS session_id, o_custkey % 50 % 7 = 0 AS replay,
    o_totalprice / 1e6 AS p, o_totalprice / 1e7 AS l FROM orders)
SELECT session_id, replay, round(sum(p), 6) AS provider_usd, round(sum(l), 6) AS llm_usd,
  round(sum(p + l), 6) AS total_usd FROM s GROUP BY ALL
UNION ALL SELECT 'running total (live sessions)', false, round(sum(p), 6), round(sum(l), 6),
  round(sum(p + l), 6) FROM s WHERE NOT replay""",
)
def session_spend(spark, sf_dir):
    n, price = F.col("o_custkey") % 50, F.col("o_totalprice")
    r = V.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), n.cast("string")).alias("session_id"),
        (n % 7 == 0).alias("replay"),
        (price / 1e6).alias("provider_usd"),
        (price / 1e7).alias("llm_usd"),
        (price / 1e6 + price / 1e7).alias("total_usd"),
    )
    got = G.session_spend(r)
    return got.select(
        "session_id", "replay",
        *[F.round(c, 6).alias(c) for c in ("provider_usd", "llm_usd", "total_usd")],
    )


@query(
    "a24_source_costs",
    SETTLED.rstrip() + """, m AS (SELECT CASE event_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'tiktok'
    WHEN 2 THEN 'news' ELSE 'google_maps' END AS source, count(*) AS n_mentions FROM events GROUP BY ALL),
c AS (SELECT source, sum(cost_usd) FILTER (cost_source = '/v1/runs') AS usd FROM settled GROUP BY source)
SELECT source, coalesce(n_mentions, 0) AS n_mentions, round(coalesce(usd, 0), 6) AS usd
FROM m FULL JOIN c USING (source)""",
)
def source_costs(spark, sf_dir):
    got = C.source_costs(V.ev_labelled(spark, sf_dir), settled(spark, sf_dir)[0])
    return got.withColumn("usd", F.round("usd", 6))


@query(
    "a28_scorecard",
    f"""SELECT round(provider_usd, 6) AS total_usd, round(agreement, 9) AS agreement, provider_usd < 5 AS h1,
  coalesce(agreement >= 0.85::DOUBLE, false) AS h3, provider_usd > 0 AS h4
FROM ({TOTALS} SELECT provider_usd FROM tot), ({LQ.LABELS} SELECT
  count(*) FILTER (audited AND t_status = 'ok' AND t_label = c_label) /
    nullif(count(*) FILTER (audited AND t_status = 'ok'), 0) AS agreement FROM lab)""",
)
def scorecard(spark, sf_dir):
    """The billed cost of the runs and the agreement of the audit sample against the thresholds."""
    cost = G.totals(settled(spark, sf_dir)[0]).withColumn("total_usd", F.col("provider_usd"))
    got = C.scorecard(cost, L.audit(LQ.labelled(spark, sf_dir)))
    return got.withColumns({c: F.round(c, n) for c, n in (("total_usd", 6), ("agreement", 9))})


_PLAN_ROWS = ", ".join(
    f"('{r[0]}', '{r[2]}', {r[3]}, {r[4]}, {r[5]}, {r[6]}::DOUBLE, {r[7]}::DOUBLE, {r[8]}::DOUBLE)"
    for r in config.SOURCE_PLAN
)
_PLAN = f"plan(source, unit, smoke, lite, full_, res, call, look) AS (VALUES {_PLAN_ROWS})"


@query(
    "f20_planned_cost",
    f"""WITH {_PLAN}, c AS (SELECT CASE event_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'tiktok'
  WHEN 2 THEN 'news' ELSE 'google_maps' END AS source, count(*) AS n FROM events GROUP BY ALL)
SELECT source, n, round(CASE WHEN full_ = 0 THEN 0 ELSE CASE WHEN unit = 'results' THEN call + full_ * res
  ELSE full_ * call END + look END, 9) AS estimate, round(call + n * res, 9) AS unit_cost
FROM plan JOIN c USING (source)""",
)
def planned_cost(spark, sf_dir):
    n = V.ev_labelled(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = G.source_plan(spark).join(n, "source")
    return plan.select(
        "source", "n", F.round(S.estimate_usd("full"), 9).alias("estimate"),
        F.round(S.unit_cost("n"), 9).alias("unit_cost"),
    )


@query(
    "q03_ledger_rules",
    LEDGER + """SELECT local_seq, rule FROM (SELECT local_seq, unnest(list_filter([
    CASE WHEN cost_source = 'unreconciled' AND n_results = 3 THEN 'unreconciled_with_cost' END,
    CASE WHEN run_id IS NULL AND n_results = 4 THEN 'no_run_id_not_local' END,
    CASE WHEN cost_source = 'local' AND n_results = 3 THEN 'local_with_cost' END],
    lambda r: r IS NOT NULL)) AS rule FROM ledger)""",
)
def ledger_rules(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    spoiled = rows.withColumns(
        {
            "cost_usd": F.when(F.col("n_results") == 3, 1.5).otherwise(F.col("cost_usd")),
            "cost_source": F.when(
                (F.col("n_results") == 4) & F.col("run_id").isNull(), "odd"
            ).otherwise(F.col("cost_source")),
        }
    )
    return G.ledger_violations(spoiled)


@query(
    "q06_verify_receipt",
    "SELECT 'as_built' AS receipt, 'not_reconciled' AS status, true AS totals_match,"
    " true AS digest_matches UNION ALL SELECT 'edited', 'invalid', false, true"
    " FROM (SELECT count(*) AS n FROM orders) WHERE n > 0",
)
def verify_receipt(spark, sf_dir):
    rows, unmatched = settled(spark, sf_dir)
    rows = rows.drop("write_seq")
    one = F.lit(1).alias("_one")
    stored = (
        G.totals(rows).select(one, "*")
        .join(G.verdict(rows, unmatched).select(one, "verdict"), "_one")
        .join(G.ledger_digest(rows).select(one, "content_digest"), "_one")
        .drop("_one")
        .withColumn("replay", F.lit(False))
    )
    edited = stored.withColumn("runs_billed", F.col("runs_billed") + 1)
    check = lambda s, name: G.verify_receipt(s, rows, unmatched).select(
        F.lit(name).alias("receipt"), "status", "totals_match", "digest_matches"
    )
    return check(stored, "as_built").unionByName(check(edited, "edited"))
