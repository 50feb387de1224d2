"""A whole brief: payloads to digest and receipt tables."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.operators import counts, dedup, events, frame, labels, ledger, sets, topics
from earshot.plans.stats import StatsPlan
from earshot.settings import checkpoint_dir
from earshot.sources import normalise, payloads


@dataclass(frozen=True)
class Inputs:
    """What a brief reads. Model answers and vectors are tables keyed by mention and brand.

    ``terms`` maps the brand, then its competitors, to their aliases. ``runs`` are run bodies,
    ``log`` the run log lines (with ``write_seq``), ``listing`` the provider's billing list.
    """

    terms: Mapping[str, Sequence[str]]
    sources: Sequence[str]
    now: datetime
    started: datetime
    reconciled: datetime
    runs: DataFrame
    observations: DataFrame
    tiebreaks: DataFrame
    vectors: DataFrame
    log: DataFrame
    listing: DataFrame
    llm_calls: DataFrame
    lexicon: Mapping[str, int] | None = None
    # Optional: looked-up entities (brand, source, entity); the planner's coverage gaps, skipped
    # sources (source, reason, note) and notes (note, position).
    entities: DataFrame | None = None
    gaps: DataFrame | None = None
    skipped: DataFrame | None = None
    notes: DataFrame | None = None


def run(spark: SparkSession, x: Inputs, b: int = config.B_LIVE, seed: int = config.SEED) -> dict[str, DataFrame]:
    """Every table of the brief.

    The stages that many tables read (parsed items, deduplicated mentions, labels, topics) are
    checkpointed: written once to the shared folder, which also cuts the plan behind them.
    """
    checkpoint_dir(spark)
    items = payloads.payload_items(x.runs)
    lost = None
    if x.entities is not None:
        # Only sources that need a lookup are held back by it.
        looked_up = x.entities.select("source").distinct()
        found, lost = normalise.resolved_reviews(items.join(looked_up, "source", "left_semi"), x.entities)
        items = items.join(looked_up, "source", "left_anti").unionByName(found)
    parsed = normalise.parse_all(items, x.terms, x.sources).checkpoint()
    fetched = normalise.mentions(parsed)
    deduped = dedup.dedup(fetched).checkpoint()
    kept = dedup.kept(deduped)
    labelled_rows = labels.label_mentions(
        kept, x.observations, x.tiebreaks, x.lexicon, seed
    ).checkpoint()
    scored = kept.withColumn("engagement_score", S.engagement_score("engagement"))
    joined = frame.join_labels(scored, labelled_rows)
    topic = topics.build_topics(joined, x.vectors, b=b, seed=seed)
    topic = {name: table.checkpoint() for name, table in topic.items()}
    with_topics = topics.assign_topics(joined, topic["assignments"]).checkpoint()
    brands = frame.brand_table(spark, list(x.terms))
    settled, unmatched = ledger.reconcile(
        ledger.fold_log(x.log), x.listing, x.started, x.reconciled
    )
    settled = settled.checkpoint()
    grid = counts.coverage_grid(
        brands, list(x.sources), fetched.select("brand", "source"),
        spark.createDataFrame([], "brand string, source string, reason string"),
    )
    per_source = fetched.groupBy("brand", "source").agg(F.count(F.lit(1)).alias("n"))
    outcomes = normalise.run_outcomes(parsed).filter("reason is not null")
    abstained = counts.source_abstentions(grid, per_source, settled).join(
        outcomes.groupBy("brand", "source").agg(F.min("reason").alias("_why")), ["brand", "source"], "left"
    ).select("scope", "brand", "source", F.coalesce("_why", "reason").alias("reason"), F.lit("").alias("detail"))
    wanted = spark.createDataFrame([(s,) for s in x.sources], "source string")
    basis = frame.basis_names(frame.basis_sources(wanted, abstained))
    stats = StatsPlan(
        with_topics, brands, basis, x.now, b, seed,
        topic_names=topic["topics"].select("topic_id", "name"),
    )
    totals = ledger.totals(settled)
    usage = ledger.llm_usage(x.llm_calls)
    spent = usage.agg(F.sum("usd").alias("llm_usd"), F.sum("tokens").alias("llm_tokens"))
    one = F.lit(1).alias("_one")
    totals = totals.select(one, "*").join(spent.select(one, "*"), "_one").drop("_one").withColumn(
        "total_usd", F.col("provider_usd") + F.col("llm_usd")
    )
    audit = labels.audit(labelled_rows)
    if lost is not None:
        abstained = abstained.unionByName(lost.select("scope", "brand", "source", "reason", F.lit("").alias("detail"))).distinct()
    gap = "source string, reason string, note string"
    none = spark.createDataFrame([], gap)
    gaps, skipped = (none if table is None else table for table in (x.gaps, x.skipped))
    notes = x.notes if x.notes is not None else spark.createDataFrame([], "note string, position long")
    verdict = ledger.verdict(settled, unmatched)
    stored = totals.withColumn("_one", F.lit(1))
    for table in (verdict.select("verdict"), ledger.ledger_digest(settled).select("content_digest")):
        stored = stored.join(table.withColumn("_one", F.lit(1)), "_one")
    stored = stored.drop("_one").withColumn("replay", F.lit(False))
    place = lambda df: df.withColumn("position", F.lit(0)).select(
        "scope", "brand", "source", "reason", "detail", "position"
    )
    return {
        **stats.tables(),
        "mentions": kept,
        "labels": labelled_rows,
        "drift": normalise.drifted(parsed),
        "topics": topic["topics"],
        "top_mentions": events.top_mentions(with_topics),
        "abstentions": sets.merge_abstentions(
            place(abstained), place(stats.abstentions()), place(topic["abstentions"])
        ),
        "mention_counts": counts.mention_counts(kept),
        "funnel": counts.funnel(fetched, kept, labelled_rows, dedup.dropped(deduped)),
        "audit": audit,
        "ledger": settled,
        "unmatched_remote": unmatched,
        "totals": totals,
        "llm_usage": usage,
        "verdict": verdict,
        "receipt_check": ledger.verify_receipt(stored, settled, unmatched),
        "coverage_gaps": sets.coverage_gaps(gaps, skipped),
        "notes": sets.distinct_notes(notes),
        "parse_report": counts.parse_report(parsed),
        "source_costs": counts.source_costs(kept, settled),
        "comparison": ledger.comparison(totals),
        "scorecard": counts.scorecard(totals, audit),
    }
