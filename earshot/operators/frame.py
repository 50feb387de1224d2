"""Rows the statistics read, and the pre-aggregates every estimate comes from."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S

# What a row contributes to: at most sources x periods x polarities x 2 combinations exist, so a
# resampling unit never carries more than that many cells.
CELL = ("source", "period", "polarity", "confirmed")


def usable(status="status") -> Column:
    """P01."""
    return F.col(status).isin(*config.USABLE_STATUSES)


def relevant_for_stats() -> Column:
    """P02."""
    return usable() & F.col("about_brand") & (F.size("matched_terms") > 0)


def relevant_for_digest() -> Column:
    """P03."""
    return usable() & F.col("about_brand") & (F.col("label") != "irrelevant")


def join_labels(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """J02. Mentions with their label; rows without one drop."""
    return mentions.join(labels, ["mention_id", "brand"])


def unlabelled(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """J02. Mentions that no label row covers."""
    return mentions.join(labels.select("mention_id", "brand"), ["mention_id", "brand"], "left_anti")


def brand_table(spark: SparkSession, brands) -> DataFrame:
    """The compared brands in order; a short list given by the caller."""
    if len(set(brands)) != len(brands):
        raise ValueError("brands must be distinct")
    return spark.createDataFrame(
        [(brand, i) for i, brand in enumerate(brands)], "brand string, brand_order int"
    )


def basis_sources(sources: DataFrame, abstentions: DataFrame) -> DataFrame:
    """J07. Requested sources without those any brand abstained on."""
    gone = abstentions.filter("scope = 'source' and source is not null").select("source")
    return sources.select("source").distinct().join(gone, "source", "left_anti")


def basis_names(basis: DataFrame) -> list[str]:
    """The basis on the driver: source names come from a fixed list of ten."""
    known = basis.filter(F.col("source").isin(*config.SOURCES)).distinct()
    found = {row["source"] for row in known.collect()}
    return [source for source in config.SOURCES if source in found]


def stats_rows(labelled: DataFrame, now: datetime) -> DataFrame:
    """P02, F15, F16. The relevant mention-brand rows with period, day and polarity."""
    polarity = F.when(F.col("label").isin(*config.POLARITIES), F.col("label"))
    return labelled.filter(relevant_for_stats()).withColumns(
        {
            "period": S.period_of("published_at", now),
            "day": S.utc_day("published_at"),
            "polarity": polarity,
            "confirmed": F.col("corroboration") == "confirmed",
        }
    )


def unit_cells(rows: DataFrame) -> DataFrame:
    """A23. Rows counted per unit (brand, cluster_key) and cell. All estimates start here."""
    return rows.groupBy("brand", "cluster_key", *CELL).agg(F.count(F.lit(1)).alias("n"))


def mark_basis(cells: DataFrame, basis: Sequence[str]) -> DataFrame:
    """Adds ``in_basis``."""
    return cells.withColumn("in_basis", F.col("source").isin(*basis))


def _scoped(condition: Column | None, suffix: str) -> list[Column]:
    """Per-unit row counts in the full window and in both periods."""
    n = F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)
    return [
        F.sum(n).alias(f"n_{suffix}"),
        F.sum(F.when(F.col("period") == "current", n).otherwise(0)).alias(f"cur_{suffix}"),
        F.sum(F.when(F.col("period") == "previous", n).otherwise(0)).alias(f"prev_{suffix}"),
    ]


def brand_counts(cells: DataFrame, brands: DataFrame) -> DataFrame:
    """A05, A06. Mentions and distinct clusters per brand: full, current and previous.

    Columns ending in ``_basis`` count basis sources only (share of voice), ``_all`` every source
    (net). Brands without a row get zeros.
    """
    units = cells.groupBy("brand", "cluster_key").agg(
        *_scoped(F.col("in_basis"), "basis"), *_scoped(None, "all")
    )
    names = [f"{scope}_{kind}" for kind in ("basis", "all") for scope in ("n", "cur", "prev")]
    totals = units.groupBy("brand").agg(
        *[F.sum(name).alias(name) for name in names],
        *[F.count_if(F.col(name) > 0).alias(f"clusters_{name}") for name in names],
    )
    filled = brands.join(totals, "brand", "left")
    return filled.fillna(0, subset=[*names, *[f"clusters_{name}" for name in names]])


def below_minimum(estimand: str, suffix: str, both_periods: bool) -> Column:
    """P06. The reason text, or null when the minimums hold. Levels look at the current period."""

    def parts(column: str, name: str):
        n, k = F.col(f"{column}_{suffix}"), F.col(f"clusters_{column}_{suffix}")
        return [
            F.when(
                n < config.MIN_MENTIONS,
                F.format_string(f"n=%d < {config.MIN_MENTIONS} in {name}", n),
            ),
            F.when(
                k < config.MIN_CLUSTERS,
                F.format_string(f"n_clusters=%d < {config.MIN_CLUSTERS} in {name}", k),
            ),
        ]

    failures = parts("cur", "current") + (parts("prev", "previous") if both_periods else [])
    text = F.concat_ws("; ", *failures)
    return F.when(text != "", F.concat(F.lit(f"{estimand}: "), text))


def polarity_sums(n: Column, condition: Column | None = None, suffix: str = "") -> list[Column]:
    """A03. pos, neg and neu sums of ``n`` where ``condition`` holds."""
    out = []
    for short, polarity in (("pos", "positive"), ("neg", "negative"), ("neu", "neutral")):
        keep = F.col("polarity") == polarity
        keep = keep if condition is None else keep & condition
        out.append(F.coalesce(F.sum(F.when(keep, n)), F.lit(0)).cast("long").alias(short + suffix))
    return out


def wow_scope(labelled: DataFrame) -> DataFrame:
    """A10. Whether any item of (brand, source) carries a date, over all fetched rows."""
    return labelled.groupBy("brand", "source").agg(
        F.bool_or(F.col("published_at").isNotNull()).alias("wow_scope")
    )


def unit_index(rows: DataFrame) -> DataFrame:
    """W13. Dense 0..n-1 over (brand_order, brand, cluster_key), in that order."""
    from earshot.operators.ranking import bucketed_rank, range_bucket

    units = rows.select("brand_order", "brand", "cluster_key").distinct()
    ranked = bucketed_rank(
        units,
        [],
        [F.col("brand_order"), range_bucket(units, "cluster_key")],
        [F.col("cluster_key")],
        "unit",
    )
    return ranked.withColumn("unit", F.col("unit") - 1)
