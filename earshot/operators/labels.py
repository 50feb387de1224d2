"""Two-signal labelling: who is asked twice, and which label stands.

Model answers are input tables: ``observations`` and ``tiebreaks`` carry (mention_id, brand,
status, label, about_brand, confidence, rationale). ``observations`` may mark rows served from the
cache with ``cached``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import text as X
from earshot.operators.ranking import bucketed_rank, keep_first
from earshot.settings import keep

_ANSWER = ("status", "label", "about_brand", "confidence", "rationale")


def prefixed(answers: DataFrame, prefix: str, extra=()) -> DataFrame:
    names = [c for c in (*_ANSWER, *extra) if c in answers.columns]
    return answers.select("mention_id", "brand", *[F.col(c).alias(prefix + c) for c in names])


def is_relevant() -> Column:
    return F.col("c_about_brand") & (F.size("matched_terms") > 0)


def is_policy_row() -> Column:
    """P04. An ok answer with a polarity on a relevant row."""
    return (F.col("c_status") == "ok") & is_relevant() & F.col("c_label").isin(*config.POLARITIES)


def is_triggered(label="c_label", confidence="c_confidence", signal="signal.label") -> Column:
    """P05. The signals disagree, or there is no second signal and the first is unsure."""
    return F.when(F.col(signal).isNotNull(), F.col(label) != F.col(signal)).otherwise(
        F.col(confidence) < config.TIEBREAK_CONFIDENCE
    )


def observed(
    mentions: DataFrame, observations: DataFrame, lexicon=None, text: str = "text",
    normalized: bool = False,
) -> DataFrame:
    """Mentions with their classifier answer (``c_``) and the deterministic ``signal``."""
    if "cached" not in observations.columns:
        observations = observations.withColumn("cached", F.lit(False))
    joined = mentions.join(prefixed(observations, "c_", ("cached",)), ["mention_id", "brand"])
    return joined.withColumn(
        "signal", X.deterministic_signal("source", "rating", text, lexicon, normalized)
    )


def audit_draw(seed: int = config.SEED) -> Column:
    """The number that orders a brand's rows for the audit: a hash of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("mention_id")))


def audit_sample(policy: DataFrame, seed: int = config.SEED) -> DataFrame:
    """W07. ``audited``: the floor(10 %) rows of each brand with the lowest draw.

    The draw is uniform, so its leading digits split any brand into equal buckets; no brand is
    ever sorted in one task.
    """
    drawn = policy.withColumn("_draw", audit_draw(seed))
    ranked = bucketed_rank(
        drawn, ["brand"], [F.substring("_draw", 1, 3)], [F.col("_draw"), F.col("mention_id")], "_rank"
    )
    sizes = policy.groupBy("brand").agg(F.count(F.lit(1)).alias("n_policy"))
    return (
        ranked.join(sizes, "brand")
        .withColumn(
            "audited", F.col("_rank") <= F.floor(F.lit(config.AUDIT_FRACTION) * F.col("n_policy"))
        )
        .drop("_draw", "_rank")
    )


def tiebreak_plan(policy: DataFrame, seed: int = config.SEED) -> DataFrame:
    """W08. ``audited``, ``triggered``, ``called`` and ``overflow`` for every policy row.

    Audit rows come first, then triggered rows by date (undated last) and id, up to 40 % of the
    brand's rows; triggered rows beyond that overflow.
    """
    sampled = audit_sample(policy, seed).withColumn("triggered", is_triggered())
    wanted = sampled.filter(F.col("audited") | F.col("triggered")).select(
        "mention_id", "brand", "audited", "published_at", "n_policy"
    )
    late = F.when(F.col("audited"), 0).when(F.col("published_at").isNotNull(), 1).otherwise(2)
    # A second of one brand can be a spike; inside it, and without a date, the id spreads the rows.
    second = F.when(~F.col("audited"), F.date_trunc("second", "published_at"))
    exact = F.when(late == 1, F.col("published_at"))
    bucket = [
        late,
        F.coalesce(second, F.lit("1970-01-01").cast("timestamp")),
        F.coalesce(exact, F.lit("1970-01-01").cast("timestamp")),
        F.substring("mention_id", 1, 3),
    ]
    order = [
        late, F.when(late == 1, F.col("published_at")).asc_nulls_first(), F.col("mention_id"),
    ]
    ranked = bucketed_rank(wanted, ["brand"], bucket, order, "_rank")
    cap = F.floor(F.lit(config.TIEBREAK_CAP) * F.col("n_policy"))
    turns = ranked.select(
        "mention_id", "brand", (F.col("audited") | (F.col("_rank") <= cap)).alias("called")
    )
    return sampled.join(turns, ["mention_id", "brand"], "left").withColumns(
        {
            "called": F.coalesce("called", F.lit(False)),
            "overflow": F.col("triggered") & ~F.coalesce("called", F.lit(False)),
        }
    )


def corroborate() -> Column:
    """L01, L03. Struct of label, corroboration, decided_by, confidence, rationale, overflow."""
    label, signal = F.col("c_label"), F.col("signal.label")
    has_answer = F.col("t_status").isNotNull()
    adoptable = (
        (F.col("t_status") == "ok")
        & F.coalesce("t_about_brand", F.lit(False))
        & F.col("t_label").isin(*config.POLARITIES)
    )
    triggered = is_triggered()
    agree = signal.isNotNull() & (label == signal)
    backed = triggered & adoptable & (F.col("t_label") == label)
    overruled = ~agree & triggered & adoptable & (F.col("t_label") != label)

    def pick(first: Column, second: Column) -> Column:
        return F.when(overruled, second).otherwise(first)

    return F.struct(
        pick(label, F.col("t_label")).alias("label"),
        F.when(agree | backed, "confirmed")
        .when(overruled, "contested")
        .otherwise("model_only")
        .alias("corroboration"),
        pick(F.lit("classifier"), F.lit("tiebreak")).alias("decided_by"),
        pick(F.col("c_confidence"), F.col("t_confidence")).alias("confidence"),
        X.clip_rationale(
            pick(F.coalesce("c_rationale", F.lit("")), F.coalesce("t_rationale", F.lit("")))
        ).alias("rationale"),
        (~agree & triggered & ~has_answer).alias("overflow"),
    )


def label_mentions(
    mentions: DataFrame,
    observations: DataFrame,
    tiebreaks: DataFrame,
    lexicon=None,
    seed: int = config.SEED,
    text: str = "text",
    normalized: bool = False,
) -> DataFrame:
    """L05. One label per mention-brand row; rows whose classifier failed keep its status.

    Only the ``called`` rows of the plan take their tiebreak answer (J12).
    """
    seen = observed(mentions, observations, lexicon, text, normalized)
    narrow = seen.select(
        "mention_id", "brand", "published_at", "signal", "c_status", "c_label", "c_about_brand",
        "c_confidence", "c_rationale", "c_cached", "matched_terms",
    ).withColumn("policy", is_policy_row())
    # Read several times below and free of texts: keep it, so texts are scored once.
    narrow = keep(narrow)
    plan = tiebreak_plan(narrow.filter("policy"), seed).select(
        "mention_id", "brand", "audited", "triggered", "called"
    )
    asked = plan.join(prefixed(tiebreaks, "t_"), ["mention_id", "brand"], "left")
    answers = [F.when(F.col("called"), F.col(f"t_{c}")).alias(f"t_{c}") for c in _ANSWER]
    joined = narrow.join(
        asked.select("mention_id", "brand", "audited", "triggered", "called", *answers),
        ["mention_id", "brand"],
        "left",
    )
    decided = joined.withColumn("d", F.when(F.col("policy"), corroborate()))
    ok = F.col("c_status") == "ok"
    irrelevant = ok & ~F.col("policy")
    cached = F.coalesce("c_cached", F.lit(False))

    def of(field: str, otherwise) -> Column:
        return F.when(F.col("policy"), F.col(f"d.{field}")).when(irrelevant, otherwise)

    failed_call = F.col("t_status").isNotNull() & (F.col("t_status") != "ok")
    tiebreak = F.when(
        F.col("t_status").isNotNull(),
        F.struct(
            F.when(failed_call, F.col("c_label")).otherwise(F.col("t_label")).alias("label"),
            F.when(failed_call, 0.0).otherwise(F.col("t_confidence")).alias("confidence"),
            F.col("t_status").alias("status"),
        ),
    )
    return decided.select(
        "mention_id",
        "brand",
        of("label", F.lit("irrelevant")).alias("label"),
        F.when(F.col("policy"), F.lit(True)).when(ok, F.col("c_about_brand")).alias("about_brand"),
        of("confidence", F.col("c_confidence")).alias("confidence"),
        of("rationale", X.clip_rationale(F.coalesce("c_rationale", F.lit("")))).alias("rationale"),
        F.struct(
            F.struct(
                F.col("c_label").alias("label"),
                F.col("c_confidence").alias("confidence"),
                F.when(cached, "cached").otherwise("ok").alias("status"),
            ).alias("classifier"),
            tiebreak.alias("tiebreak"),
            F.col("signal").alias("deterministic"),
            F.coalesce("d.overflow", F.lit(False)).alias("overflow"),
        ).alias("signals"),
        of("corroboration", F.lit("irrelevant")).alias("corroboration"),
        of("decided_by", F.lit("classifier")).alias("decided_by"),
        # L04: cached only without a second call.
        F.when(~ok, F.col("c_status"))
        .when(cached & F.col("t_status").isNull(), "cached")
        .otherwise("ok")
        .alias("status"),
        F.coalesce("audited", F.lit(False)).alias("audited"),
    )


def audit(labels: DataFrame) -> DataFrame:
    """A15. Agreement on the audit sample, calls made, calls the cap refused."""
    tiebreak = F.col("signals.tiebreak")
    answered = F.col("audited") & (F.col("signals.tiebreak.status") == "ok")
    agree = answered & (F.col("signals.tiebreak.label") == F.col("signals.classifier.label"))
    counts = labels.agg(
        F.count_if(answered).alias("n_sample"),
        F.count_if(agree).alias("n_agree"),
        F.count_if(tiebreak.isNotNull()).alias("tiebreak_calls"),
        F.count_if(F.col("signals.overflow")).alias("tiebreak_overflow"),
    )
    return counts.withColumn(
        "agreement", F.try_divide(F.col("n_agree").cast("double"), F.col("n_sample").cast("double"))
    )


def batches(rows: DataFrame, bucket, order, size: int = config.BATCH_SIZE) -> DataFrame:
    """W15. ``batch`` number per brand: chunks of ``size`` in row order."""
    ranked = bucketed_rank(rows, ["brand"], bucket, order, "_rank")
    return ranked.withColumns(
        {
            "batch": F.floor((F.col("_rank") - 1) / size).cast("long"),
            "in_batch": ((F.col("_rank") - 1) % size).cast("long"),
        }
    ).drop("_rank")


def apportion(items: DataFrame, calls: DataFrame) -> DataFrame:
    """A16. A call's tokens and cost over the items of its batch.

    Tokens split evenly with the remainder on the first items, so they sum exactly.
    ``items`` has (brand, batch, in_batch), ``calls`` (brand, batch, tokens, cost_usd).
    """
    sizes = items.groupBy("brand", "batch").agg(F.count(F.lit(1)).alias("_n"))
    joined = items.join(calls.join(sizes, ["brand", "batch"]), ["brand", "batch"])
    base = F.floor(F.col("tokens") / F.col("_n"))
    extra = (F.col("in_batch") < F.col("tokens") % F.col("_n")).cast("long")
    return joined.withColumns(
        {"tokens": base + extra, "cost_usd": F.col("cost_usd") / F.col("_n")}
    ).drop("_n")


def cache_lookup(
    mentions: DataFrame, cache: DataFrame, prompt_rev: str, model: str
) -> tuple[DataFrame, DataFrame]:
    """J03. (hits with the cached answer, misses). The key is id, brand, prompt and model."""
    current = cache.filter(
        (F.col("prompt_rev") == prompt_rev) & (F.col("model") == model)
    ).drop("prompt_rev", "model")
    keys = ["mention_id", "brand"]
    return mentions.join(current, keys), mentions.join(current.select(*keys), keys, "left_anti")


def align_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """L06. One observation per asked row: its first answer, or ``unparseable``.

    ``answers`` has (mention_id, brand, position, label, about_brand, confidence, rationale).
    """
    first = keep_first(answers, ["mention_id", "brand"], ["position"]).drop("position")
    found = first.withColumn("_found", F.lit(True))
    joined = asked.select("mention_id", "brand").join(found, ["mention_id", "brand"], "left")
    return joined.withColumns(
        {
            "status": F.when(F.col("_found"), "ok").otherwise("unparseable"),
            "rationale": F.when(F.col("_found"), F.col("rationale")).otherwise(
                "id missing from answer"
            ),
        }
    ).drop("_found")


def classify_misses(misses: DataFrame, classify, schema: str) -> DataFrame:
    """X02. Run a user-supplied ``classify(batches of pandas rows) -> rows`` on the cache misses."""
    return misses.mapInPandas(classify, schema)
