"""Daily counts, leave-one-out baselines and spike days."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.functions.text import first_words
from earshot.operators.ranking import top_per_group


def mention_order():
    """W04. Engagement descending, newest first with undated last, then id."""
    return [
        F.col("engagement_score").desc(),
        F.col("published_at").desc_nulls_last(),
        F.col("mention_id").asc(),
    ]


def event_calendar(brands: DataFrame, now: datetime) -> DataFrame:
    """J11. Each brand with the 14 UTC dates ending on ``now``'s date."""
    last = now.date()
    first = last - timedelta(days=config.EVENT_DAYS - 1)
    days = F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
    return brands.select("brand", F.explode(days).alias("day"))


def daily_counts(rows: DataFrame) -> DataFrame:
    """A18, A05. Mentions and distinct clusters per brand and day, combined map-side."""
    per_cluster = (
        rows.filter(F.col("day").isNotNull())
        .groupBy("brand", "day", "cluster_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_cluster.groupBy("brand", "day").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters")
    )


def filled_days(rows: DataFrame, brands: DataFrame, now: datetime) -> DataFrame:
    """J11. Daily counts on the calendar, zero where nothing was said."""
    return (
        event_calendar(brands, now)
        .join(daily_counts(rows), ["brand", "day"], "left")
        .fillna(0, subset=["n", "n_clusters"])
    )


def _median(values):
    """Median of a short array column."""
    ordered = F.sort_array(values)
    size = F.size(ordered)
    low = F.element_at(ordered, F.floor((size + 1) / 2).cast("int"))
    high = F.element_at(ordered, F.floor(size / 2).cast("int") + 1)
    return (low + high) / 2.0


def baselines(days: DataFrame) -> DataFrame:
    """A19, F26. Median and MAD of the other days, and the threshold. 14 counts per brand."""
    counts = F.sort_array(F.collect_list(F.struct("day", "n", "n_clusters"))).alias("days")
    per_brand = days.groupBy("brand").agg(counts)
    each = per_brand.select("brand", "days", F.posexplode("days").alias("at", "d"))
    others = F.transform(
        F.filter("days", lambda o: o["day"] != F.col("d.day")), lambda o: o["n"].cast("double")
    )
    centred = each.withColumn("others", others).withColumn("baseline_median", _median(F.col("others")))
    spread = F.transform("others", lambda v: F.abs(v - F.col("baseline_median")))
    return centred.withColumn("baseline_mad", _median(spread)).select(
        "brand",
        F.col("d.day").alias("day"),
        F.col("d.n").alias("n"),
        F.col("d.n_clusters").alias("n_clusters"),
        "baseline_median",
        "baseline_mad",
        S.event_threshold("baseline_median", "baseline_mad").alias("threshold"),
    )


def spike_days(rows: DataFrame, brands: DataFrame, now: datetime) -> DataFrame:
    """P08. Days at or above the threshold with enough distinct clusters."""
    return baselines(filled_days(rows, brands, now)).filter(
        (F.col("n") > 0)
        & (F.col("n") >= F.col("threshold"))
        & (F.col("n_clusters") >= config.EVENT_MIN_CLUSTERS)
    )


def exhibits(rows: DataFrame) -> DataFrame:
    """W05. The first mention of each brand and day in mention order."""
    return top_per_group(rows.filter("day is not null"), ["brand", "day"], mention_order(), 1)


def largest_topics(rows: DataFrame) -> DataFrame:
    """W06. The topic with most rows per brand and day, ties by topic id."""
    counted = (
        rows.filter("topic_id is not null and day is not null")
        .groupBy("brand", "day", "topic_id")
        .agg(F.count(F.lit(1)).alias("n_topic"))
    )
    return top_per_group(counted, ["brand", "day"], [F.desc("n_topic"), F.asc("topic_id")], 1)


def detect_events(
    rows: DataFrame, brands: DataFrame, now: datetime, topic_names: DataFrame | None = None
) -> DataFrame:
    """Spike days with label and exhibit. ``topic_names`` has (topic_id, name)."""
    spikes = spike_days(rows, brands, now)
    # Reduce the rows to the spike days before ranking them.
    on_day = rows.join(spikes.select("brand", "day"), ["brand", "day"], "left_semi")
    shown = exhibits(on_day).select(
        "brand", "day", F.col("url").alias("exhibit_url"),
        first_words(F.col("matched_terms")[0], 6).alias("term_label"),
    )
    out = spikes.join(shown, ["brand", "day"], "left")
    if topic_names is None:
        label = F.col("term_label")
    else:
        # J15. The name of the day's largest topic, where it has one.
        named = largest_topics(on_day).join(topic_names, "topic_id").select(
            "brand", "day", first_words("name", 6).alias("topic_label")
        )
        out = out.join(named, ["brand", "day"], "left")
        label = F.coalesce(F.when(F.col("topic_label") != "", F.col("topic_label")), "term_label")
    return out.select(
        "brand", F.col("day").alias("date"), "n", "n_clusters",
        "baseline_median", "baseline_mad", "threshold", label.alias("label"), "exhibit_url",
    )


def top_mentions(labelled: DataFrame, k: int = config.TOP_MENTIONS) -> DataFrame:
    """W04, P03, F17. The first ``k`` digest rows per brand, with their quote."""
    from earshot.functions.text import quote
    from earshot.operators.frame import relevant_for_digest

    ranked = top_per_group(
        labelled.filter(relevant_for_digest()), ["brand"], mention_order(), k
    )
    return ranked.withColumn("quote", quote("text")) if "text" in labelled.columns else ranked
