"""Labelling queries over documents and labels."""

from pyspark.sql import functions as F

from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.operators import frame as R
from earshot.operators import labels as L
from earshot.settings import keep

SIG = V.with_("docm", "sig")
_POLICY = ("c_status = 'ok' AND c_about AND len(terms) > 0 AND c_label IN "
           "('positive', 'negative', 'neutral')")
_TRIG = "CASE WHEN s_label IS NOT NULL THEN c_label <> s_label ELSE c_conf < 0.6::DOUBLE END"
PLAN = SIG + f""", pol AS (SELECT *, {_TRIG} AS trig,
    row_number() OVER (PARTITION BY brand ORDER BY md5('777:' || mention_id), mention_id) AS ar,
    count(*) OVER (PARTITION BY brand) AS np FROM sig WHERE {_POLICY}),
aud AS (SELECT *, ar <= floor(0.1::DOUBLE * np) AS audited FROM pol),
trn AS (SELECT mention_id, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN audited THEN 0
      WHEN ts IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN NOT audited THEN ts END, mention_id) AS tr
  FROM aud WHERE audited OR trig),
pln AS (SELECT a.*, coalesce(a.audited OR tr <= floor(0.4::DOUBLE * np), false) AS called,
    trig AND NOT coalesce(a.audited OR tr <= floor(0.4::DOUBLE * np), false) AS overflow
  FROM aud a LEFT JOIN trn USING (mention_id))"""


def seen(spark, sf_dir):
    return L.observed(
        V.doc_mentions(spark, sf_dir), V.doc_observations(spark, sf_dir).drop("doc_id"),
        V.DOC_LEXICON, "norm", True,
    )


def policy(spark, sf_dir):
    """Policy rows without their texts; the plan reads them several times."""
    return keep(seen(spark, sf_dir).drop("text", "norm")).filter(L.is_policy_row())


@query(
    "p01_usable_labels",
    V.with_("docm") + "SELECT brand, count(*) AS n FROM docm WHERE c_status IN ('ok', 'cached')"
    " GROUP BY brand",
)
def usable_labels(spark, sf_dir):
    o = V.doc_observations(spark, sf_dir).filter(R.usable())
    return o.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("p04_policy_rows", SIG + f"SELECT doc_id, {_POLICY} AS policy FROM sig")
def policy_rows(spark, sf_dir):
    return seen(spark, sf_dir).select("doc_id", L.is_policy_row().alias("policy"))


@query("p05_tiebreak_trigger", SIG + f"SELECT doc_id, {_TRIG} AS triggered FROM sig WHERE {_POLICY}")
def tiebreak_trigger(spark, sf_dir):
    return policy(spark, sf_dir).select("doc_id", L.is_triggered().alias("triggered"))


@query("w07_audit_sample", PLAN + "SELECT doc_id, audited FROM aud")
def audit_sample(spark, sf_dir):
    return L.audit_sample(policy(spark, sf_dir)).select("doc_id", "audited")


@query("w08_tiebreak_plan", PLAN + "SELECT doc_id, audited, trig AS triggered, called, overflow FROM pln")
def tiebreak_plan(spark, sf_dir):
    got = L.tiebreak_plan(policy(spark, sf_dir))
    return got.select("doc_id", "audited", "triggered", "called", "overflow")


@query(
    "j12_tiebreak_answers",
    PLAN + "SELECT doc_id, CASE WHEN called THEN t_label END AS t_label,"
    " CASE WHEN called THEN t_status END AS t_status FROM pln",
)
def tiebreak_answers(spark, sf_dir):
    plan = L.tiebreak_plan(policy(spark, sf_dir)).select("doc_id", "mention_id", "brand", "called")
    answers = L.prefixed(V.doc_tiebreaks(spark, sf_dir), "t_")
    called = lambda c: F.when(F.col("called"), F.col(c)).alias(c)
    joined = plan.join(answers, ["mention_id", "brand"], "left")
    return joined.select("doc_id", called("t_label"), called("t_status"))


LABELS = PLAN + """, adopt AS (SELECT *, called AND t_status = 'ok' AND t_label <> 'irrelevant' AS ad,
    s_label IS NOT NULL AND c_label = s_label AS agree FROM pln),
dcd AS (SELECT *, NOT agree AND trig AND ad AND t_label <> c_label AS over FROM adopt),
lab AS (SELECT s.doc_id, s.mention_id, s.brand, s.c_status, s.c_label, s.c_about, s.c_conf, s.c_cached,
  s.s_label, d.audited, d.called, d.t_status, d.t_label,
  CASE WHEN d.doc_id IS NOT NULL THEN CASE WHEN over THEN d.t_label ELSE s.c_label END
    WHEN s.c_status = 'ok' THEN 'irrelevant' END AS label,
  CASE WHEN d.doc_id IS NOT NULL THEN CASE WHEN agree OR (trig AND ad AND d.t_label = s.c_label)
      THEN 'confirmed' WHEN over THEN 'contested' ELSE 'model_only' END
    WHEN s.c_status = 'ok' THEN 'irrelevant' END AS corroboration,
  CASE WHEN d.doc_id IS NOT NULL THEN CASE WHEN over THEN 'tiebreak' ELSE 'classifier' END
    WHEN s.c_status = 'ok' THEN 'classifier' END AS decided_by,
  CASE WHEN d.doc_id IS NOT NULL THEN CASE WHEN over THEN d.t_conf ELSE s.c_conf END
    WHEN s.c_status = 'ok' THEN s.c_conf END AS confidence,
  coalesce(d.doc_id IS NOT NULL AND NOT agree AND trig AND NOT called, false) AS overflow,
  CASE WHEN s.c_status <> 'ok' THEN s.c_status WHEN s.c_cached AND NOT coalesce(called, false)
    THEN 'cached' ELSE 'ok' END AS status,
  CASE WHEN d.doc_id IS NOT NULL THEN true WHEN s.c_status = 'ok' THEN s.c_about END AS about_brand
FROM sig s LEFT JOIN dcd d ON s.doc_id = d.doc_id)"""


def labelled(spark, sf_dir):
    return L.label_mentions(
        V.doc_mentions(spark, sf_dir),
        V.doc_observations(spark, sf_dir).drop("doc_id"),
        V.doc_tiebreaks(spark, sf_dir),
        V.DOC_LEXICON,
        text="norm",
        normalized=True,
    )


@query(
    "l05_label_mentions",
    LABELS + """SELECT mention_id, brand, label, corroboration, decided_by,
  round(confidence, 9) AS confidence, overflow, status FROM lab""",
)
def label_mentions(spark, sf_dir):
    got = labelled(spark, sf_dir)
    return got.select(
        "mention_id", "brand", "label", "corroboration", "decided_by",
        F.round("confidence", 9).alias("confidence"), F.col("signals.overflow").alias("overflow"),
        "status",
    )


@query(
    "l01_corroboration",
    LABELS + """SELECT corroboration, decided_by, label, count(*) AS n FROM lab
WHERE c_status = 'ok' AND corroboration <> 'irrelevant' GROUP BY ALL""",
)
def corroboration(spark, sf_dir):
    got = labelled(spark, sf_dir).filter("corroboration <> 'irrelevant'")
    return got.groupBy("corroboration", "decided_by", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l02_irrelevant_rows",
    LABELS + """SELECT brand, about_brand, count(*) AS n FROM lab WHERE corroboration = 'irrelevant'
GROUP BY ALL""",
)
def irrelevant_rows(spark, sf_dir):
    got = labelled(spark, sf_dir).filter("corroboration = 'irrelevant'")
    return got.groupBy("brand", "about_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l03_failed_tiebreaks",
    LABELS + """SELECT mention_id, c_label AS recorded, 0.0 AS confidence, corroboration FROM lab
WHERE called AND t_status <> 'ok'""",
)
def failed_tiebreaks(spark, sf_dir):
    got = labelled(spark, sf_dir).filter("signals.tiebreak.status <> 'ok'")
    return got.select(
        "mention_id", F.col("signals.tiebreak.label").alias("recorded"),
        F.col("signals.tiebreak.confidence").alias("confidence"), "corroboration",
    )


@query("l04_label_status", LABELS + "SELECT status, count(*) AS n FROM lab GROUP BY status")
def label_status(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a15_audit",
    LABELS + """SELECT count(*) FILTER (audited AND t_status = 'ok') AS n_sample,
  count(*) FILTER (audited AND t_status = 'ok' AND t_label = c_label) AS n_agree,
  count(*) FILTER (called) AS tiebreak_calls, count(*) FILTER (overflow) AS tiebreak_overflow,
  round(count(*) FILTER (audited AND t_status = 'ok' AND t_label = c_label) /
    nullif(count(*) FILTER (audited AND t_status = 'ok'), 0), 9) AS agreement FROM lab""",
)
def audit(spark, sf_dir):
    return L.audit(labelled(spark, sf_dir)).withColumn("agreement", F.round("agreement", 9))


@query(
    "j02_labelled_mentions",
    "SELECT d.lang AS brand, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled"
    " FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang",
)
def labelled_mentions(spark, sf_dir):
    m = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("mention_id"), F.col("lang").alias("brand"), "source"
    )
    lab = V.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "mention_id")
    lab = m.select("mention_id", "brand").join(lab, "mention_id")
    count = lambda df, name: df.groupBy("brand").agg(F.count(F.lit(1)).alias(name))
    have = count(R.join_labels(m, lab), "labelled")
    lack = count(R.unlabelled(m, lab), "unlabelled")
    return have.join(lack, "brand", "full_outer").fillna(0)


def _cache(spark, sf_dir):
    o = V.doc_observations(spark, sf_dir)
    rev = F.when(F.col("doc_id") % 3 == 0, "rev-2").otherwise("rev-1")
    model = F.when(F.col("doc_id") % 5 == 0, "small").otherwise("large")
    return o.select("mention_id", "brand", "label", rev.alias("prompt_rev"), model.alias("model"))


@query(
    "j03_label_cache",
    V.with_("docm") + """SELECT brand, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses
FROM (SELECT brand, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS hit FROM docm) GROUP BY brand""",
)
def label_cache(spark, sf_dir):
    m = V.doc_mentions(spark, sf_dir).select("mention_id", "brand")
    hits, misses = L.cache_lookup(m, _cache(spark, sf_dir), "rev-2", "large")
    count = lambda df, name: df.groupBy("brand").agg(F.count(F.lit(1)).alias(name))
    return count(hits, "hits").join(count(misses, "misses"), "brand", "full_outer").fillna(0)


@query(
    "l06_align_answers",
    V.with_("docm") + """SELECT mention_id, brand, CASE WHEN doc_id % 9 <> 0 THEN 'ok' ELSE 'unparseable' END
  AS status, CASE WHEN doc_id % 9 <> 0 THEN c_label END AS label FROM docm""",
)
def align_answers(spark, sf_dir):
    o = V.doc_observations(spark, sf_dir)
    answer = lambda position, label: o.filter(F.col("doc_id") % 9 != 0).select(
        "mention_id", "brand", F.lit(position).alias("position"), label.alias("label"), "rationale"
    )
    answers = answer(2, F.lit("late")).unionByName(answer(1, F.col("label")))
    return L.align_answers(o, answers).select("mention_id", "brand", "status", "label")


_BATCH = V.with_("doc") + """, bt AS (SELECT doc_id, brand, (row_number() OVER (PARTITION BY brand
    ORDER BY seq, doc_id) - 1) // 20 AS batch, (row_number() OVER (PARTITION BY brand
    ORDER BY seq, doc_id) - 1) % 20 AS in_batch FROM doc)"""


def _batched(spark, sf_dir):
    m = V.doc_items(spark, sf_dir).select(
        "doc_id", "brand", (F.col("doc_id") % 7 + 1).alias("seq"), F.col("doc_id").alias("idx")
    )
    bucket = [F.col("seq"), F.floor(F.col("idx") / 1000)]
    return L.batches(m, bucket, [F.col("seq"), F.col("idx")])


@query("w15_batches", _BATCH + "SELECT doc_id, brand, batch, in_batch FROM bt")
def batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("doc_id", "brand", "batch", "in_batch")


@query(
    "a16_apportioned_usage",
    _BATCH + """, c AS (SELECT brand, batch, count(*) AS n, 1000 + batch * 37 AS tokens,
    0.25 + batch / 8.0::DOUBLE AS cost FROM bt GROUP BY ALL)
SELECT doc_id, tokens // n + CASE WHEN in_batch < tokens % n THEN 1 ELSE 0 END AS tokens,
  round(cost / n, 9) AS cost_usd FROM bt JOIN c USING (brand, batch)""",
)
def apportioned(spark, sf_dir):
    items = _batched(spark, sf_dir)
    calls = items.select("brand", "batch").distinct().select(
        "brand", "batch", (1000 + F.col("batch") * 37).alias("tokens"),
        (0.25 + F.col("batch") / 8.0).alias("cost_usd"),
    )
    got = L.apportion(items, calls)
    return got.select("doc_id", "tokens", F.round("cost_usd", 9).alias("cost_usd"))
