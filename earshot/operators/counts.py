"""Counts by dimension, the mention funnel, coverage, abstentions and scorecards."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S


def mention_counts(mentions: DataFrame) -> DataFrame:
    """A01. Counts by brand, by source, by language and by match kind, in one pass."""
    dims = ("brand", "source", "lang", "match_kind")
    grouped = mentions.groupingSets(
        [[F.col(d)] for d in dims], *[F.col(d) for d in dims]
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*dims).alias("_g"))
    # grouping_id has a 0 bit at the one dimension that is present.
    last = len(dims) - 1
    name = F.coalesce(*[
        F.when(F.shiftright(F.col("_g").cast("long"), last - i) % 2 == 0, d)
        for i, d in enumerate(dims)
    ])
    value = F.coalesce(*[F.col(d) for d in dims])
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def funnel(fetched: DataFrame, kept: DataFrame, labels: DataFrame, dropped: DataFrame) -> DataFrame:
    """A02. One row: fetched, deduped, labelled, unlabelled and every exclusion reason.

    ``labels`` has (mention_id, brand, status, about_brand, label), ``dropped`` a ``reason``.
    """
    joined = kept.select("mention_id", "brand").join(
        labels.select("mention_id", "brand", "status", "about_brand", "label"),
        ["mention_id", "brand"],
        "left",
    )
    status, usable = F.col("status"), F.col("status").isin(*config.USABLE_STATUSES)
    by_label = joined.agg(
        F.count(F.lit(1)).alias("deduped"),
        F.count_if(usable).alias("labelled"),
        F.count_if(status.isNull()).alias("unlabelled"),
        F.count_if(usable & ~F.col("about_brand")).alias("not_about_brand"),
        F.count_if(usable & F.col("about_brand") & (F.col("label") == "irrelevant")).alias(
            "irrelevant_label"
        ),
        *[F.count_if(status == s).alias(s) for s in config.FAILED_LABEL_STATUSES],
    )
    by_rule = dropped.agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in config.EXCLUSION_REASONS[5:]]
    )
    total = fetched.agg(F.count(F.lit(1)).alias("fetched"))
    one = F.lit(1).alias("_one")
    return (
        total.select(one, "*")
        .join(by_label.select(one, "*"), "_one")
        .join(by_rule.select(one, "*"), "_one")
        .drop("_one")
    )


def h2_entries(by_source: DataFrame) -> DataFrame:
    """A25. Thread-clustered entries that meet the minimums, and whether the effect is there."""
    return by_source.filter(
        F.col("source").isin(*config.THREAD_SOURCES)
        & (F.col("n") >= config.MIN_MENTIONS)
        & (F.col("n_clusters") >= config.MIN_CLUSTERS)
    ).withColumn("passed", F.col("design_effect") >= config.H2_MIN_DESIGN_EFFECT)


def coverage_grid(
    brands: DataFrame, sources: list[str], returned: DataFrame, abstained: DataFrame
) -> DataFrame:
    """J08. Every expected (brand, source), and what became of it.

    ``returned`` has (brand, source), ``abstained`` adds a reason. Comments under videos are
    expected only where videos are.
    """
    wanted = [s for s in sources if s != "youtube_comment" or "youtube" in sources]
    grid = brands.select("brand", F.explode(F.array(*[F.lit(s) for s in wanted])).alias("source"))
    got = returned.select("brand", "source", F.lit(True).alias("_got")).distinct()
    why = abstained.groupBy("brand", "source").agg(F.min("reason").alias("reason"))
    return (
        grid.join(got, ["brand", "source"], "left")
        .join(why, ["brand", "source"], "left")
        .select(
            "brand",
            "source",
            F.when(F.col("reason").isNotNull(), "abstained")
            .when(F.col("_got"), "returned")
            .otherwise("not_fetched")
            .alias("state"),
            "reason",
        )
    )


def source_abstentions(grid: DataFrame, counts: DataFrame, runs: DataFrame) -> DataFrame:
    """A27. Expected pairs without a mention, with the reason of their failed run, else empty.

    ``runs`` has (brand, source, local_seq, status, provider_http_status).
    """
    failed = (
        runs.withColumn("_why", S.abstain_reason("status", "provider_http_status"))
        .filter("_why is not null")
        .groupBy("brand", "source")
        .agg(F.min_by("_why", "local_seq").alias("_why"))
    )
    have = counts.filter("n > 0").select("brand", "source")
    return (
        grid.select("brand", "source")
        .join(have, ["brand", "source"], "left_anti")
        .join(failed, ["brand", "source"], "left")
        .select(
            F.lit("source").alias("scope"), "brand", "source",
            F.coalesce("_why", F.lit("empty")).alias("reason"),
        )
    )


def scorecard(totals: DataFrame, audit: DataFrame) -> DataFrame:
    """A28. Cost and agreement against their thresholds; an undefined value does not pass."""
    one = F.lit(1).alias("_one")
    both = totals.select(one, "total_usd").join(audit.select(one, "agreement"), "_one")
    return both.select(
        "total_usd",
        "agreement",
        (F.col("total_usd") < config.H1_MAX_USD).alias("h1"),
        F.coalesce(F.col("agreement") >= config.H3_MIN_AGREEMENT, F.lit(False)).alias("h3"),
        (F.col("total_usd") > config.H4_MIN_USD).alias("h4"),
    )


def parse_report(parsed: DataFrame) -> DataFrame:
    """A26. Per (brand, source): key fallbacks, items without a match, items without text."""
    return parsed.groupBy("brand", "source").agg(
        F.count_if("cluster_key_fell_back").alias("cluster_key_fallbacks"),
        F.count_if("no_match").alias("skipped_no_match"),
        F.count_if("no_text").alias("skipped_no_text"),
    )


def source_costs(mentions: DataFrame, runs: DataFrame) -> DataFrame:
    """A24. Mentions and billed cost per source."""
    spoken = mentions.groupBy("source").agg(F.count(F.lit(1)).alias("n_mentions"))
    billed = runs.groupBy("source").agg(
        F.sum(F.when(F.col("cost_source") == config.BILLED, F.col("cost_usd"))).alias("usd")
    )
    return spoken.join(billed, "source", "full_outer").fillna(0, subset=["n_mentions", "usd"])
