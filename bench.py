"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from earshot import config
from earshot.catalog import QUERIES
from earshot.catalog import views as V
from earshot.operators import frame as R
from earshot.plans.stats import StatsPlan
from earshot.settings import tune

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# One query per stage of a brief.
HEADLINE = (
    "w03_dedup", "f07_detect_lang", "f08_match_terms", "f11_deterministic_signal", "a01_mention_counts",
    "a02_funnel", "w08_tiebreak_plan", "l05_label_mentions", "a15_audit", "a07_share_of_voice",
    "a03_polarity_counts", "a04_by_source_counts", "p08_events", "w04_top_mentions", "v01_close_pairs",
    "v02_average_linkage", "v04_cosine_top_k_many", "w02_ledger_fold", "j06_reconcile", "a11_totals",
    "j16_repeated_requests", "j14_number_gate", "src02_reddit", "src11_news", "q08_privacy_scan",
)


def full_stats(spark, sf_dir):
    """Every statistic with the live number of resamples."""
    plan = StatsPlan(
        V.ev_labelled(spark, sf_dir), R.brand_table(spark, V.BRANDS), V.EV_BASIS, V.NOW,
        b=config.B_LIVE,
    )
    return plan, (plan.share_of_voice(), plan.sentiment(), plan.by_source(), plan.events(), plan.abstentions())


def consume(df):
    """Run the whole query; nothing is brought to the driver."""
    df.agg(F.count(F.lit(1)), F.max(F.xxhash64(*df.columns)) if df.columns else F.lit(0)).collect()


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("earshot-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    # Start the JVM's and Python's workers before timing.
    consume(QUERIES["f01_normalize"](spark, SF_DIR))
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        consume(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    start = time.perf_counter()
    plan, tables = full_stats(spark, SF_DIR)
    for table in tables:
        table.collect()
    times["b08_full_stats"] = round(time.perf_counter() - start, 3)
    plan.close()
    print(
        json.dumps(
            {
                "metric": "brief_stages_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
