"""Rule checks over stored tables. Each gives one row per violation, so empty means sound."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.operators.ledger import rule_violations

__all__ = [
    "digest_violations", "estimate_violations", "label_violations", "mention_violations",
    "placeholder_hits", "privacy_hits", "unpaired_nulls",
]


def mention_violations(mentions: DataFrame) -> DataFrame:
    """Q01."""
    blank = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"(?U)\S")
    allowed = F.array(*[F.lit(k) for k in config.ENGAGEMENT_KEYS])
    odd_keys = F.size(F.array_except(F.map_keys("engagement"), allowed)) > 0
    review = F.col("source").isin(*config.REVIEW_SOURCES)
    rating, expected = F.col("rating"), S.expected_cluster_key("source", "mention_id", "author_hash")
    return rule_violations(
        mentions,
        ["mention_id", "brand"],
        {
            "blank_text": F.col("text").isNull() | blank("text"),
            "blank_run_id": blank("run_id"),
            "blank_native_id": blank("native_id"),
            "blank_url": blank("url"),
            "unknown_source": ~F.col("source").isin(*config.SOURCES),
            "engagement_key": odd_keys,
            "blank_term": F.exists("matched_terms", lambda t: ~t.rlike(r"(?U)\S")),
            "rating_range": review & rating.isNotNull() & ~rating.between(1, 5),
            "rating_on_other_source": ~review & rating.isNotNull(),
            "cluster_key": expected.isNotNull() & (F.col("cluster_key") != expected),
            "mention_id_shape": ~F.col("mention_id").rlike("^[0-9a-f]{24}$"),
            "author_hash_shape": ~F.col("author_hash").rlike("^[0-9a-f]{16}$"),
            "raw_ref_shape": ~F.col("raw_ref").rlike(r"^[0-9]+#[0-9]+$"),
        },
    )


def label_violations(labels: DataFrame) -> DataFrame:
    """Q02."""
    c, by = F.col("corroboration"), F.col("decided_by")
    tiebreak = F.col("signals.tiebreak")
    overflow = F.col("signals.overflow")
    irrelevant = ~F.col("about_brand") | (F.col("label") == "irrelevant")
    answered = tiebreak.isNotNull() & (F.col("signals.tiebreak.status") == "ok")
    words = F.size(F.split(F.trim("rationale"), r"(?U)\s+"))
    return rule_violations(
        labels,
        ["mention_id", "brand"],
        {
            "tiebreak_without_signal": (by == "tiebreak") & tiebreak.isNull(),
            "irrelevant_mismatch": irrelevant != (c == "irrelevant"),
            "cached_with_usage": (F.col("status") == "cached")
            & ((F.col("usage.tokens") != 0) | (F.col("usage.cost_usd") != 0.0)),
            "overflow_with_tiebreak": overflow & tiebreak.isNotNull(),
            "overflow_confirmed": overflow & ~c.isin("model_only", "irrelevant"),
            "contested_not_tiebreak": (c == "contested") & (tiebreak.isNull() | (by != "tiebreak")),
            "tiebreak_not_contested": (by == "tiebreak") & (c != "contested"),
            "failed_call_adopted": tiebreak.isNotNull() & ~answered & (c == "contested"),
            "unbacked_not_model_only": ~irrelevant
            & F.col("signals.deterministic.label").isNull()
            & ~answered
            & (c != "model_only"),
            "long_rationale": words > config.RATIONALE_WORDS,
        },
    )


def estimate_violations(estimates: DataFrame, keys) -> DataFrame:
    """Q04. Columns n, pos, neg, neu, net, ci_lo, ci_hi, iid_lo, iid_hi, design_effect."""
    labelled = F.col("pos") + F.col("neg") + F.col("neu")
    net, de = F.col("net"), F.col("design_effect")
    width = F.col("iid_hi") - F.col("iid_lo")
    expected = S.design_effect("ci_lo", "ci_hi", "iid_lo", "iid_hi")
    some = F.col("ci_lo").isNotNull() | F.col("iid_lo").isNotNull() | de.isNotNull()
    lacking = F.col("ci_lo").isNull() | F.col("iid_lo").isNull()
    return rule_violations(
        estimates,
        keys,
        {
            "net_without_labels": (labelled == 0) & net.isNotNull(),
            "labels_exceed_n": labelled > F.col("n"),
            "interval_without_net": net.isNull() & some,
            "net_without_interval": net.isNotNull() & lacking,
            "unordered_interval": (F.col("ci_lo") > F.col("ci_hi")) | (F.col("iid_lo") > F.col("iid_hi")),
            "effect_without_width": (width == 0) & de.isNotNull(),
            "effect_differs": (width != 0)
            & net.isNotNull()
            & (de.isNull() | (F.abs(de - expected) > 1e-6 * F.abs(expected))),
        },
    )


def unpaired_nulls(estimates: DataFrame, abstentions: DataFrame) -> DataFrame:
    """Q05. Null estimates without an abstention for their brand (and source, where they have one).

    ``estimates`` has (scope, brand, source, what, value); a null design effect or confirmed-only
    interval counts only with a ``degenerate`` row, so give those ``needs_degenerate``.
    """
    nulls = estimates.filter("value is null")
    degenerate = F.col("needs_degenerate")
    why = abstentions.select(
        F.col("brand").alias("_b"), F.col("source").alias("_s"), F.col("reason").alias("_r"),
        F.col("scope").alias("_scope"),
    )
    topic = F.col("scope") == "topics"
    pairs = (
        (F.col("brand") == F.col("_b"))
        & F.when(degenerate, (F.col("_r") == "degenerate") & F.col("source").eqNullSafe(F.col("_s")))
        .when(topic, F.col("_scope") == "topics")
        .otherwise(F.col("_s").isNull() | F.col("_s").eqNullSafe(F.col("source")))
    )
    return nulls.join(why, pairs, "left_anti").select("scope", "brand", "source", "what")


def privacy_hits(
    table: DataFrame, keys, columns, patterns: Mapping[str, str] = config.PRIVACY_PATTERNS
) -> DataFrame:
    """Q08. How often each pattern occurs in each text column, where it occurs."""
    counts = [
        F.struct(F.lit(c).alias("column"), F.lit(name).alias("pattern"),
                 F.regexp_count(c, F.lit(p)).alias("n"))
        for c in columns
        for name, p in patterns.items()
    ]
    found = F.filter(F.array(*counts), lambda hit: hit["n"] > 0)
    return table.select(*keys, F.explode(found).alias("hit")).select(*keys, "hit.*")


def placeholder_hits(table: DataFrame, keys, column: str) -> DataFrame:
    """Q09. Rows whose text still holds a placeholder word."""
    return table.filter(F.col(column).rlike(config.PLACEHOLDER_PATTERN)).select(*keys)


def digest_violations(gaps: DataFrame, topics: DataFrame, top_mentions: DataFrame) -> DataFrame:
    """Q10. The fixed coverage gap is there, topics and top mentions are in order and bounded.

    ``topics`` has (brand, topic_id, position), ``top_mentions`` (brand, engagement_score,
    published_at, mention_id, rank).
    """
    x = gaps.filter("source = 'x' and reason = 'unavailable'")
    no_gap = x.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("x_gap_missing").alias("rule"), F.lit(None).cast("string").alias("brand")
    )
    at = Window.partitionBy("brand").orderBy("position")
    topic_order = topics.withColumn("_last", F.lag("topic_id").over(at)).filter(
        F.col("_last") >= F.col("topic_id")
    ).select(F.lit("topics_order").alias("rule"), "brand").distinct()
    counts = top_mentions.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    too_many = counts.filter(F.col("n") > config.TOP_MENTIONS).select(
        F.lit("too_many_mentions").alias("rule"), "brand"
    )
    ranked = Window.partitionBy("brand").orderBy("rank")
    key = F.struct(
        (-F.col("engagement_score")).alias("a"),
        (-F.coalesce(F.unix_micros("published_at"), F.lit(-(1 << 62)))).alias("b"),
        F.col("mention_id").alias("c"),
    )
    order = top_mentions.withColumn("_key", key).withColumn(
        "_last", F.lag("_key").over(ranked)
    ).filter(F.col("_last") > F.col("_key")).select(
        F.lit("mentions_order").alias("rule"), "brand"
    ).distinct()
    return no_gap.unionByName(topic_order).unionByName(too_many).unionByName(order)
