"""Rule checks, ordered unions, samples, stored tables and streams."""


from pyspark.sql import functions as F

from earshot import config, schemas
from earshot.catalog import label_queries as LQ
from earshot.catalog import source_queries as SQ
from earshot.catalog import stats_queries as TQ
from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.operators import events as E
from earshot.operators import quality as Q
from earshot.operators import sampling
from earshot.operators import sets as U
from earshot.sources import normalise as M
from earshot.sources import tables as T
from earshot.streaming import streams


# -- rule checks ------------------------------------------------------------------------------------
@query(
    "q01_mention_rules",
    SQ.oracle("youtube", "'v' || doc_id", where="true").rsplit("SELECT mid", 1)[0] + """
SELECT mid AS mention_id, unnest(list_filter([
    CASE WHEN doc_id % 7 = 0 THEN 'rating_on_other_source' END,
    CASE WHEN doc_id % 11 = 0 THEN 'cluster_key' END,
    CASE WHEN doc_id % 13 = 0 THEN 'blank_url' END,
    CASE WHEN doc_id % 17 = 0 THEN 'engagement_key' END,
    CASE WHEN doc_id % 19 = 0 THEN 'raw_ref_shape' END], lambda r: r IS NOT NULL)) AS rule FROM y""",
)
def mention_rules(spark, sf_dir):
    got = M.mentions(M.parse(SQ.items(spark, sf_dir, "youtube"), "youtube", SQ.TERMS))
    i = F.split("raw_ref", "#")[1].cast("long")
    odd = F.map_concat("engagement", F.create_map(F.lit("claps"), F.lit(1).cast("long")))
    spoiled = got.withColumn("i", i).withColumns(
        {
            "rating": F.when(F.col("i") % 7 == 0, 3),
            "cluster_key": F.when(F.col("i") % 11 == 0, "other").otherwise(F.col("cluster_key")),
            "url": F.when(F.col("i") % 13 == 0, " ").otherwise(F.col("url")),
            "engagement": F.when(F.col("i") % 17 == 0, odd).otherwise(F.col("engagement")),
            "raw_ref": F.when(F.col("i") % 19 == 0, "12").otherwise(F.col("raw_ref")),
        }
    )
    return Q.mention_violations(spoiled).select("mention_id", "rule")


@query(
    "q02_label_rules",
    LQ.LABELS + """SELECT mention_id, unnest(list_filter([
  CASE WHEN doc_id % 7 = 0 AND (label <> 'irrelevant') THEN 'irrelevant_mismatch' END,
  CASE WHEN doc_id % 11 = 0 AND status = 'cached' THEN 'cached_with_usage' END],
  lambda r: r IS NOT NULL)) AS rule FROM lab WHERE c_status = 'ok'""",
)
def label_rules(spark, sf_dir):
    rows = LQ.labelled(spark, sf_dir).filter("label is not null")
    ids = V.doc_mentions(spark, sf_dir).select("mention_id", "doc_id")
    spoil = (F.col("doc_id") % 7 == 0) & (F.col("label") != "irrelevant")
    usage = F.struct(
        F.when(F.col("doc_id") % 11 == 0, 5).otherwise(0).cast("long").alias("tokens"),
        F.lit(0.0).alias("cost_usd"),
    )
    # A relevant label called irrelevant: its corroboration no longer agrees.
    spoiled = rows.join(ids, "mention_id").withColumns(
        {
            "about_brand": F.when(spoil, False).otherwise(F.col("about_brand")),
            "usage": usage,
        }
    )
    return Q.label_violations(spoiled).select("mention_id", "rule")


@query(
    "q04_estimate_rules",
    "SELECT 'none' AS rule, 0::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) = 0"
    " UNION ALL SELECT 'effect_differs', count(*) FROM (SELECT DISTINCT event_type FROM events)",
)
def estimate_rules(spark, sf_dir):
    good = TQ.plan(spark, sf_dir).sentiment()
    bad = good.withColumn("design_effect", F.col("design_effect") * 2)
    hits = Q.estimate_violations(good, ["brand"]).unionByName(Q.estimate_violations(bad, ["brand"]))
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _unpaired(plan):
    sov, sent = plan.share_of_voice(), plan.sentiment()
    row = lambda df, what, value, degenerate=False: df.select(
        F.lit("brand").alias("scope"), "brand", F.lit(None).cast("string").alias("source"),
        F.lit(what).alias("what"), value.cast("double").alias("value"),
        F.lit(degenerate).alias("needs_degenerate"),
    )
    return row(sov, "share", F.col("share")).unionByName(row(sent, "net", F.col("net")))


@query(
    "q05_unpaired_nulls",
    TQ._MINIMUMS.rsplit("SELECT brand, CASE", 1)[0]
    + "SELECT 'net' AS what, brand FROM txt WHERE level <> '' UNION ALL SELECT 'share', brand FROM"
    " (SELECT brand FROM rel WHERE in_basis GROUP BY brand HAVING count(*) FILTER (period = 'current') < 20"
    " OR count(DISTINCT cluster_key) FILTER (period = 'current') < 5)",
)
def unpaired_nulls(spark, sf_dir):
    """Nulls with no abstention at all are reported; with the plan's own rows none is."""
    plan = TQ.plan(spark, sf_dir, V.THIN)
    estimates = _unpaired(plan)
    none = plan.abstentions().filter("reason = 'no such reason'")
    lost = Q.unpaired_nulls(estimates, none).select("what", "brand")
    left = Q.unpaired_nulls(estimates, plan.abstentions()).select("what", "brand")
    return lost.unionByName(left)


_EMAIL = config.PRIVACY_PATTERNS["email"]


@query(
    "q08_privacy_scan",
    f"""SELECT doc_id, 'text' AS "column", 'email' AS pattern, len(regexp_extract_all(text, '{_EMAIL}')) AS n
FROM documents WHERE regexp_matches(text, '{_EMAIL}')""",
)
def privacy_scan(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    got = Q.privacy_hits(d, ["doc_id"], ["text"])
    return got.withColumn("n", F.col("n").cast("long"))


@query(
    "q09_placeholders",
    "SELECT doc_id FROM documents WHERE doc_id % 10 = 0",
)
def placeholders(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    marked = d.withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" (TODO)"))).otherwise(
            F.concat("text", F.lit(" TODOS")))
    )
    return Q.placeholder_hits(marked, ["doc_id"], "text")


@query(
    "q10_digest_shape",
    "SELECT 'x_gap_missing' AS rule, NULL AS brand UNION ALL SELECT DISTINCT 'too_many_mentions', event_type"
    " FROM events UNION ALL SELECT DISTINCT 'topics_order', event_type FROM events",
)
def digest_shape(spark, sf_dir):
    e = V.ev_labelled(spark, sf_dir)
    gaps = e.select("source", F.lit("unavailable").alias("reason")).distinct()
    topics = e.filter("topic_id is not null").select("brand", "topic_id").distinct().withColumn(
        "position", -F.substring("topic_id", -1, 1).cast("int")
    )
    return Q.digest_violations(gaps, topics, E.top_mentions(e, k=11))


# -- ordered unions ---------------------------------------------------------------------------------
@query(
    "u02_abstentions",
    """WITH r AS (SELECT 'source' AS scope, lang AS brand, source, doc_id, doc_id % 2 AS grp FROM documents)
SELECT scope, brand, source, min(grp) AS grp, arg_min(doc_id, (grp, doc_id)) AS position
FROM r GROUP BY scope, brand, source""",
)
def abstentions(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    part = lambda n: d.filter(F.col("doc_id") % 2 == n).select(
        F.lit("source").alias("scope"), F.col("lang").alias("brand"), "source",
        F.lit("empty").alias("reason"), F.lit("no rows").alias("detail"), F.col("doc_id").alias("position"),
    )
    got = U.merge_abstentions(part(0), part(1))
    return got.select(
        "scope", "brand", "source", F.col("at.g").cast("long").alias("grp"), F.col("at.p").alias("position")
    )


@query(
    "u03_coverage_gaps",
    f"""SELECT DISTINCT source, 'not_fetched' AS reason, lang AS note FROM documents
UNION ALL SELECT '{config.X_GAP[0]}', '{config.X_GAP[1]}', '{config.X_GAP[2]}'""",
)
def coverage_gaps(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(
        "source", F.lit("not_fetched").alias("reason"), F.col("lang").alias("note")
    ).distinct()
    return U.coverage_gaps(d.filter("note = 'en'"), d.filter("note <> 'en'"))


@query(
    "u04_notes",
    f"""SELECT source || ': ' || lang AS note, min(doc_id) AS first FROM documents GROUP BY ALL
UNION ALL SELECT '{config.X_NOTE}', 0""",
)
def notes(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(
        F.concat_ws(": ", "source", "lang").alias("note"), F.col("doc_id").alias("position")
    )
    return U.distinct_notes(d).select("note", F.col("at.p").alias("first"))


# -- stratified sample ------------------------------------------------------------------------------
_STRATA = """WITH s AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY source),
f AS (SELECT *, 50 * n // t AS fl, 50 * n - (50 * n // t) * t AS rest FROM s),
al AS (SELECT source, n, CASE WHEN t <= 50 THEN n ELSE fl + CASE WHEN row_number() OVER (ORDER BY rest DESC,
  source) <= 50 - sum(fl) OVER () THEN 1 ELSE 0 END END AS slots FROM f)"""


@query("w12_sample_slots", _STRATA + "SELECT source, n, slots::BIGINT AS slots FROM al")
def sample_slots(spark, sf_dir):
    return sampling.allocation(V.table(spark, sf_dir, "documents"), "source", "source", 50)


@query(
    "w12_stratified_sample",
    _STRATA + """, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source
  ORDER BY md5('777:' || doc_id), doc_id::VARCHAR) AS rk FROM documents)
SELECT doc_id, r.source FROM r JOIN al USING (source) WHERE rk <= slots""",
)
def stratified_sample(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("doc_id").cast("string").alias("mention_id")
    )
    return sampling.stratified_sample(d, "source", "source").select("doc_id", "source")


# -- stored tables ----------------------------------------------------------------------------------
@query(
    "src14_mentions_table",
    SQ.oracle("youtube", "'v' || doc_id").rsplit("SELECT mid", 1)[0]
    + "SELECT mid AS mention_id, 's1' AS session_id, doc_id AS likes FROM y",
)
def mentions_table(spark, sf_dir):
    """Written as partitioned Parquet and read back."""
    got = M.mentions(M.parse(SQ.items(spark, sf_dir, "youtube"), "youtube", SQ.TERMS))
    path = T.fresh_path(spark, "mentions")
    T.write_table(got, path, "s1")
    back = T.read_table(spark, path, "s1")
    assert back.drop("session_id").columns == schemas.columns(schemas.MENTION)
    return back.select("mention_id", "session_id", F.col("engagement")["likes"].alias("likes"))


@query(
    "src15_labels_table",
    LQ.LABELS + "SELECT mention_id, brand, label, corroboration FROM lab WHERE c_status = 'ok'",
)
def labels_table(spark, sf_dir):
    """Written as JSON lines in two batches and read back, the last line per key."""
    rows = LQ.labelled(spark, sf_dir).filter("label is not null")
    path = T.fresh_path(spark, "labels")
    T.write_labels(rows.withColumns({"label": F.lit("outdated"), "corroboration": F.lit("none")}), path, 0)
    T.write_labels(rows, path, 1)
    return T.read_labels(spark, path).select("mention_id", "brand", "label", "corroboration")


@query(
    "src17_stats_object",
    TQ.EV + """SELECT 'counts' AS "table", brand, count(*) AS n_all, count(*) FILTER (in_basis) AS n_basis
FROM rel GROUP BY brand""",
)
def stats_object(spark, sf_dir):
    """Result tables as JSON objects; the rows are read back from them."""
    counts = TQ.plan(spark, sf_dir).counts().select("brand", "n_all", "n_basis")
    made = T.one_object({"counts": counts})
    rows = made.select("table", F.explode(F.from_json("json", "array<string>")).alias("row"))
    return rows.select("table", F.from_json("row", "brand string, n_all long, n_basis long").alias("r")).select("table", "r.*")


# -- streams ----------------------------------------------------------------------------------------
def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "s01_ledger_stream",
    V.with_("log", "ledger") + "SELECT local_seq, run_id, input_digest, status, cost_source FROM ledger",
)
def ledger_stream(spark, sf_dir):
    log = V.runs_log(spark, sf_dir, _stream(spark, sf_dir, "lineitem"))
    path = T.fresh_path(spark, "ledger")
    streams.start_ledger_stream(log, f"{path}/state", f"{path}/progress").awaitTermination()
    return streams.ledger_state(spark, f"{path}/state").select(
        "local_seq", "run_id", "input_digest", "status", "cost_source"
    )


@query(
    "s02_daily_stream",
    V.with_("ev") + """SELECT strftime(published_at, '%Y-%m-%d') AS day, brand, count(*) AS n,
  count(DISTINCT cluster_key) AS n_clusters FROM ev
WHERE published_at IS NOT NULL AND published_at::DATE + INTERVAL 1 DAY <=
  (SELECT max(published_at) FROM ev) - INTERVAL 2 DAY GROUP BY ALL""",
)
def daily_stream(spark, sf_dir):
    """Every event arrives twice, the copy with the lower reference in its own cluster; days close two days
    behind the newest event."""
    once = V.ev_labelled(spark, sf_dir, events=_stream(spark, sf_dir, "events")).select(
        F.col("event_id").cast("string").alias("native_id"), "url", "brand", "source", "published_at",
        "cluster_key", F.lit("").alias("text"),
    )
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn(
        "raw_ref", F.concat(F.col("copy").cast("string"), F.lit("#"), "native_id")
    ).withColumn("cluster_key", F.when(F.col("copy") == 0, F.col("cluster_key")).otherwise("other")).drop("copy")
    path = T.fresh_path(spark, "daily")
    streams.start_daily_stream(twice, f"{path}/days", f"{path}/progress").awaitTermination()
    got = streams.closed_days(spark, f"{path}/days")
    return got.select(F.col("day").cast("string").alias("day"), "brand", "n", "n_clusters")
