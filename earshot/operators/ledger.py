"""What the data cost: the run ledger, its reconciliation with the billing list, totals, checks."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.operators.ranking import keep_last

_SLACK = timedelta(seconds=60)


def source_plan(spark: SparkSession) -> DataFrame:
    """SRC19. One row per source: caps, unit and prices."""
    return spark.createDataFrame(config.SOURCE_PLAN, config.SOURCE_PLAN_SCHEMA)


def model_rates(spark: SparkSession, rates=config.MODEL_RATES) -> DataFrame:
    """SRC20. USD per million tokens by model; without a cached rate the input rate holds."""
    table = spark.createDataFrame(rates, config.MODEL_RATES_SCHEMA)
    return table.withColumn("cached_usd", F.coalesce("cached_usd", "input_usd"))


def priced_calls(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """F21. ``cost_usd`` for (model, tokens_in, cached_in, tokens_out); unknown models are errors."""
    return calls.join(rates, "model", "left").withColumn(
        "cost_usd", S.price_usage("tokens_in", "cached_in", "tokens_out")
    ).drop("input_usd", "cached_usd", "output_usd")


def fold_log(log: DataFrame) -> DataFrame:
    """W02, SRC16. The last line per ``local_seq``, by ``write_seq``."""
    return keep_last(log, ["local_seq"], ["write_seq"], with_order=False)


def in_window(listing: DataFrame, started: datetime, reconciled: datetime) -> DataFrame:
    """P09. Listed runs of the session, a minute either side; undated ones stay."""
    at = F.col("created_at")
    low, high = (
        F.lit(f"{moment:%Y-%m-%d %H:%M:%S}").cast("timestamp")
        for moment in (started - _SLACK, reconciled + _SLACK)
    )
    return listing.filter(at.isNull() | ((at >= low) & (at <= high)))


def reconcile(
    ledger: DataFrame, listing: DataFrame, started: datetime, reconciled: datetime
) -> tuple[DataFrame, DataFrame]:
    """J06. (the ledger with billed fields copied in, listed run ids the ledger lacks).

    Rows without a run id never match. A listed run without a price leaves its row unreconciled.
    When the list repeats an id its last item (``list_seq``) counts.
    """
    listed = keep_last(
        in_window(listing, started, reconciled).filter("run_id is not null"),
        ["run_id"],
        ["list_seq"],
    )
    remote = listed.select(
        F.col("run_id"),
        F.col("cost_usd").alias("r_cost"),
        F.col("billed_units").alias("r_units"),
        F.col("status").alias("r_status"),
        F.col("provider_http_status").alias("r_http"),
    )
    # Rows without an id can't match; they pass beside the join instead of meeting in one task.
    joined = (
        ledger.filter("run_id is not null")
        .join(remote, "run_id", "left")
        .unionByName(ledger.filter("run_id is null"), allowMissingColumns=True)
    )
    billed = F.col("r_cost").isNotNull()

    def take(new, old):
        return F.when(billed, new).otherwise(F.col(old)).alias(old)

    changed = {
        "cost_usd": take(F.col("r_cost"), "cost_usd"),
        "billed_units": take(F.col("r_units"), "billed_units"),
        "status": take(F.coalesce(F.when(F.col("r_status") != "", F.col("r_status")), "status"), "status"),
        "provider_http_status": take(
            F.coalesce("r_http", "provider_http_status"), "provider_http_status"
        ),
        "cost_source": take(F.lit(config.BILLED), "cost_source"),
    }
    settled = joined.select(*[changed.get(c, F.col(c)) for c in ledger.columns])
    unmatched = remote.select("run_id").join(
        ledger.filter("run_id is not null").select("run_id"), "run_id", "left_anti"
    )
    return settled, unmatched


def unreconciled(ledger: DataFrame) -> DataFrame:
    """A12. Rows with a run id that the list did not settle."""
    return ledger.filter("cost_source = 'unreconciled'").select("local_seq")


def reconciliation_summary(settled: DataFrame, listed: DataFrame, unmatched: DataFrame) -> DataFrame:
    """A12. Counts; the ids themselves stay tables, since their number has no bound."""
    one = F.lit(1).alias("_one")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).select(one, name)
    return (
        count(listed.select("run_id").distinct(), "n_listed_in_window")
        .join(count(unmatched, "n_unmatched_remote"), "_one")
        .join(count(unreconciled(settled), "n_unreconciled"), "_one")
        .drop("_one")
    )


def totals(ledger: DataFrame) -> DataFrame:
    """A11. Money only from reconciled rows; counts over all rows."""
    billed = F.col("cost_source") == config.BILLED
    usd = F.when(billed, F.col("cost_usd"))
    return ledger.agg(
        F.coalesce(F.sum(usd), F.lit(0.0)).alias("provider_usd"),
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("cost_usd") > 0).alias("runs_billed"),
        F.count_if(F.col("n_results") == 0).alias("runs_zero_results"),
        F.count_if(S.is_failed("status")).alias("runs_failed"),
        F.coalesce(
            F.sum(F.when(F.col("provider") == config.VOICE_PROVIDER, usd)), F.lit(0.0)
        ).alias("voice_usd"),
    )


def verdict(ledger: DataFrame, unmatched: DataFrame, replay: bool = False) -> DataFrame:
    """F29. One row with the receipt's verdict."""
    one = F.lit(1).alias("_one")
    settled = ledger.agg(
        F.coalesce(
            F.bool_and((F.col("cost_source") == config.BILLED) | F.col("run_id").isNull()),
            F.lit(True),
        ).alias("all_reconciled")
    )
    missing = unmatched.agg(F.count(F.lit(1)).alias("n_unmatched"))
    both = settled.select(one, "*").join(missing.select(one, "*"), "_one")
    return both.select(
        S.receipt_verdict(F.lit(replay), "all_reconciled", "n_unmatched").alias("verdict"),
        "all_reconciled",
        "n_unmatched",
    )


def llm_usage(calls: DataFrame) -> DataFrame:
    """A13. Calls, tokens and USD by kind; every kind has a row. Cached rows are not calls."""
    spark = calls.sparkSession
    kinds = spark.createDataFrame([(k,) for k in config.LLM_KINDS], "kind string")
    sums = calls.groupBy("kind").agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("usd")
    )
    return kinds.join(sums, "kind", "left").fillna(0)


def comparison(totals_df: DataFrame, price_month: float = config.INCUMBENT_USD_MONTH) -> DataFrame:
    """A14. Monthly equivalent at four briefs, and the price ratio (null at no cost)."""
    month = F.col("total_usd") * config.BRIEFS_PER_MONTH
    return totals_df.select(
        month.alias("usd_month_equiv"),
        F.when(month > 0, price_month / month).alias("ratio"),
    )


def session_spend(receipts: DataFrame) -> DataFrame:
    """A17. Spend per session with a total over live sessions; replays list but do not add."""
    columns = ("provider_usd", "llm_usd", "total_usd")
    per = receipts.groupBy("session_id", "replay").agg(*[F.sum(c).alias(c) for c in columns])
    live = receipts.filter("not replay").agg(*[F.sum(c).alias(c) for c in columns])
    total = live.select(
        F.lit("running total (live sessions)").alias("session_id"), F.lit(False).alias("replay"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns],
    )
    return per.unionByName(total)


def repeated_requests(ledger: DataFrame) -> DataFrame:
    """J16. Rows whose request already had a run id before them: money spent twice.

    The first such run per digest is a combined minimum; a digest many rows share stays one row
    on that side of the join, which is on a hash, so that side has an exchange of its own and the
    adaptive planner can split the rows of the digest.
    """
    when = F.struct("submitted_at", "local_seq")
    first = (
        ledger.filter("run_id is not null")
        .groupBy("input_digest")
        .agg(F.min(when).alias("_first"), F.min_by("run_id", when).alias("first_run_id"))
        .select(F.col("input_digest").alias("_digest"), F.xxhash64("input_digest").alias("_of"), "_first", "first_run_id")
    )
    hashed = ledger.withColumn("_hash", F.xxhash64("input_digest"))
    same = (F.col("_hash") == F.col("_of")) & (F.col("input_digest") == F.col("_digest"))
    return hashed.join(first, same).filter(when > F.col("_first")).select(*ledger.columns, "first_run_id")


# -- checks ---------------------------------------------------------------------------------------
def rule_violations(rows: DataFrame, keys, rules: dict) -> DataFrame:
    """One row per broken rule: the keys and the rule's name. A rule is a condition that fails."""
    failed = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]),
        lambda name: name.isNotNull(),
    )
    return rows.select(*keys, F.explode(failed).alias("rule"))


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Q03."""
    status, run_id = F.col("status"), F.col("run_id")
    source, cost = F.col("cost_source"), F.col("cost_usd")
    local = status.startswith("LOCAL_")
    return rule_violations(
        ledger,
        ["local_seq"],
        {
            "local_status_shape": local
            & ~status.rlike("^LOCAL_(REJECTED_[0-9]{3}|BACKOFF_EXHAUSTED|DEADLINE)$"),
            "local_status_with_run_id": local & (status != "LOCAL_DEADLINE") & run_id.isNotNull(),
            "billed_without_cost": (source == config.BILLED) & cost.isNull(),
            "unreconciled_with_cost": (source == "unreconciled") & cost.isNotNull(),
            "blank_run_id": F.trim(run_id) == "",
            "no_run_id_not_local": run_id.isNull() & (source != "local"),
            "local_with_run_id": (source == "local") & run_id.isNotNull(),
            "local_with_cost": (source == "local") & ~cost.eqNullSafe(F.lit(0.0)),
        },
    )


def ledger_digest(ledger: DataFrame):
    """Content digest of a ledger of any size: row hashes summed, independent of order."""
    body = F.to_json(F.struct(*sorted(ledger.columns)), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return ledger.agg(
        F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.sum(number), F.lit(0))).alias("content_digest")
    )


def verify_receipt(stored: DataFrame, ledger: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Q06. Stored totals, verdict and digest against what the rows give.

    ``stored`` is one row: the totals columns, verdict, replay and content_digest.
    """
    one = F.lit(1).alias("_one")
    fresh = totals(ledger).select(one, *[F.col(c).alias(f"x_{c}") for c in totals(ledger).columns])
    settled = verdict(ledger, unmatched).select(one, "all_reconciled", "n_unmatched")
    digest = ledger_digest(ledger).select(one, F.col("content_digest").alias("x_digest"))
    row = (
        stored.select(one, "*").join(fresh, "_one").join(settled, "_one").join(digest, "_one")
    )
    close = lambda c: F.abs(F.col(c) - F.col(f"x_{c}")) <= 1e-9 * F.greatest(
        F.lit(1.0), F.abs(F.col(f"x_{c}"))
    )
    same = lambda c: F.col(c) == F.col(f"x_{c}")
    derived = S.receipt_verdict("replay", "all_reconciled", "n_unmatched")
    totals_ok = close("provider_usd") & close("voice_usd")
    for name in ("runs", "runs_billed", "runs_zero_results", "runs_failed"):
        totals_ok = totals_ok & same(name)
    digest_ok = F.col("content_digest") == F.col("x_digest")
    valid = totals_ok & digest_ok & (F.col("verdict") == derived)
    return row.select(
        F.when(~valid, "invalid")
        .when(derived == "RECONCILED", "ok")
        .otherwise("not_reconciled")
        .alias("status"),
        totals_ok.alias("totals_match"),
        digest_ok.alias("digest_matches"),
        F.col("verdict").alias("stored_verdict"),
        derived.alias("derived_verdict"),
    )
