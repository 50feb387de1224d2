"""The given tables seen as mentions, labels, ledger rows and vectors.

Each view has a twin in SQL, so that a query over it can be checked by another engine. The
mappings use plain arithmetic on the ids only to spread values; every view covers its whole table.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import scalars as S
from earshot.settings import spread

NOW = datetime(2024, 1, 31)
SPIKES, THIN = "spikes", "thin"
SPIKE_FROM, REST = "2024-01-18", "rest"
BRANDS = ("click", "error", "purchase", "signup", "view")
EVENT_SOURCES = ("reddit", "tiktok", "news", "google_maps")


# Long texts: costly per row.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _cycle(column, values):
    out = F.when(column == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        out = out.when(column == i, value)
    return out


def with_(*views: str) -> str:
    """WITH clause of the named SQL views, in dependency order."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + "\n"


# -- events as mentions that already carry a label ------------------------------------------------
def ev_labelled(
    spark: SparkSession, sf_dir: str, shape: str | None = None, events: DataFrame | None = None
) -> DataFrame:
    """All events as labelled mentions.

    ``shape``: ``spikes`` moves a third of each brand's rows to one day, ``thin`` leaves a
    twentieth of the users with their brand and gives all others to one large brand.
    """
    e = table(spark, sf_dir, "events") if events is None else events
    eid = F.col("event_id")
    brand, at = F.col("event_type"), F.col("ts").cast("timestamp")
    if shape == SPIKES:
        day = F.date_add(F.lit(SPIKE_FROM).cast("date"), (F.length("event_type") % 5).cast("int"))
        moved = day.cast("timestamp") + (at - F.date_trunc("day", at))
        at = F.when(eid % 3 == 0, moved).otherwise(at)
    elif shape == THIN:
        brand = F.when(F.col("user_id") % 20 == 0, brand).otherwise(REST)
    source = _cycle(eid % 4, EVENT_SOURCES)
    return e.select(
        S.mention_id(source, eid.cast("string")).alias("mention_id"),
        brand.alias("brand"),
        source.alias("source"),
        eid.alias("event_id"),
        F.col("user_id").cast("string").alias("cluster_key"),
        F.when(eid % 11 != 0, at).alias("published_at"),
        F.create_map(F.lit("likes"), F.floor("value").cast("long")).alias("engagement"),
        F.floor("value").cast("long").alias("engagement_score"),
        F.concat(F.lit("https://example.org/"), eid.cast("string")).alias("url"),
        F.when(eid % 19 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("event_type"))
        .alias("matched_terms"),
        F.when(eid % 23 == 0, "irrelevant")
        .when(F.col("value") > 60, "positive")
        .when(F.col("value") < 20, "negative")
        .otherwise("neutral")
        .alias("label"),
        (eid % 13 != 0).alias("about_brand"),
        F.when(eid % 3 != 0, "confirmed").otherwise("model_only").alias("corroboration"),
        F.when(eid % 17 == 0, "error").when(eid % 17 == 1, "cached").otherwise("ok").alias("status"),
        F.when(eid % 5 < 3, F.concat("event_type", F.lit("-0"), (eid % 5 + 1).cast("string"))).alias(
            "topic_id"
        ),
    )


SQL = {}
_EV = """{name} AS (
  SELECT substr(sha256(source || chr(10) || event_id), 1, 24) AS mention_id, *
  FROM (
    SELECT event_id, {brand} AS brand, user_id::VARCHAR AS cluster_key,
      CASE event_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'news'
        ELSE 'google_maps' END AS source,
      CASE WHEN event_id % 11 <> 0 THEN {at} END AS published_at,
      floor(value)::BIGINT AS engagement_score,
      'https://example.org/' || event_id AS url,
      event_id % 19 <> 0 AS has_terms,
      CASE WHEN event_id % 23 = 0 THEN 'irrelevant' WHEN value > 60 THEN 'positive'
        WHEN value < 20 THEN 'negative' ELSE 'neutral' END AS label,
      event_id % 13 <> 0 AS about_brand,
      event_id % 3 <> 0 AS confirmed,
      CASE WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 17 = 1 THEN 'cached'
        ELSE 'ok' END AS status,
      CASE WHEN event_id % 5 < 3 THEN event_type || '-0' || (event_id % 5 + 1) END AS topic_id
    FROM events))"""
SQL["ev"] = _EV.format(name="ev", brand="event_type", at="ts")
SQL["ev_spikes"] = _EV.format(
    name="ev",
    brand="event_type",
    at=f"CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '{SPIKE_FROM}' + to_days((length(event_type) % 5)::INT)"
    " + (ts - date_trunc('day', ts)) ELSE ts END",
)
SQL["ev_thin"] = _EV.format(
    name="ev", brand=f"CASE WHEN user_id % 20 = 0 THEN event_type ELSE '{REST}' END", at="ts"
)
# Relevant rows with period, day and polarity.
SQL["rows"] = """rel AS (
  SELECT *,
    CASE WHEN published_at >= TIMESTAMP '2024-01-24' AND published_at < TIMESTAMP '2024-01-31'
      THEN 'current'
      WHEN published_at >= TIMESTAMP '2024-01-17' AND published_at < TIMESTAMP '2024-01-24'
      THEN 'previous' END AS period,
    published_at::DATE AS day,
    CASE WHEN label <> 'irrelevant' THEN label END AS polarity,
    source <> 'tiktok' AS in_basis
  FROM ev WHERE status IN ('ok', 'cached') AND about_brand AND has_terms)"""
EV_BASIS = ("reddit", "google_maps", "news")


def ev_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source nobody should be compared on: one brand got nothing from it."""
    lost = table(spark, sf_dir, "events").agg(F.min("event_type").alias("brand"))
    return lost.select(
        F.lit("source").alias("scope"), "brand", F.lit("tiktok").alias("source"),
        F.lit("empty").alias("reason"), F.lit("no rows").alias("detail"),
    )


# -- documents as mentions before dedup, and their classifier answers -----------------------------
def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        "doc_id",
        "source",
        F.col("lang").alias("brand"),
        F.when(i % 3 == 0, (i - i % 6).cast("string")).alias("native_id"),
        F.when(
            i % 3 == 1,
            F.concat(F.lit("HTTPS://Example.org/p/"), (i - i % 9).cast("string"), F.lit("/?utm_source=x&id=1#t")),
        ).alias("url"),
        "text",
        F.concat((i % 7 + 1).cast("string"), F.lit("#"), i.cast("string")).alias("raw_ref"),
    )


_NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({t}), 'ß', 'ss'),"
    " 'https?://[^\\s]+', '', 'g'), '@[\\w\\p{{L}}\\p{{N}}]+', '', 'g'), '\\s+', ' ', 'g'))"
)


def norm_sql(column: str = "text") -> str:
    return _NORM.format(t=column)


SQL["doc"] = f"""doc AS (
  SELECT doc_id, source, lang AS brand, text, {norm_sql()} AS norm,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id - doc_id % 6)::VARCHAR END AS native_id,
    CASE WHEN doc_id % 3 = 1 THEN 'https://example.org/p/' || (doc_id - doc_id % 9) || '/?id=1'
      END AS url,
    doc_id % 7 + 1 AS seq
  FROM documents)"""


def doc_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier answers: from the labels where there are some, else neutral."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    joined = d.select("doc_id", "source", "lang", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    return joined.select(
        "doc_id",
        S.mention_id("source", i.cast("string")).alias("mention_id"),
        F.col("lang").alias("brand"),
        F.when(i % 29 == 0, "refused").otherwise("ok").alias("status"),
        F.when(i % 37 == 0, "irrelevant")
        .when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
        .alias("label"),
        (i % 31 != 0).alias("about_brand"),
        (0.5 + (i % 50) / 100.0).alias("confidence"),
        F.concat(F.lit("because "), i.cast("string")).alias("rationale"),
        (i % 41 == 0).alias("cached"),
    )


def doc_tiebreaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        S.mention_id("source", i.cast("string")).alias("mention_id"),
        F.col("lang").alias("brand"),
        F.when(i % 43 == 0, "error").otherwise("ok").alias("status"),
        F.when(i % 5 == 0, "positive")
        .when(i % 5 == 1, "negative")
        .when(i % 5 == 2, "irrelevant")
        .otherwise("neutral")
        .alias("label"),
        F.lit(True).alias("about_brand"),
        (0.7 + (i % 20) / 100.0).alias("confidence"),
        F.concat(F.lit("on reflection "), i.cast("string")).alias("rationale"),
    )


DOC_TERMS = ("the", "of", "und", "la", "que")
DOC_LEXICON = {"la": 1, "the": 1, "und": 1, "of": -1, "que": -1, "der": -1}
DOC_LEX_POS = "('la', 'the', 'und')"
DOC_LEX_NEG = "('of', 'que', 'der')"


def doc_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per document, matched on frequent words."""
    from earshot.functions import text as X

    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        "doc_id",
        S.mention_id("source", i.cast("string")).alias("mention_id"),
        F.col("lang").alias("brand"),
        F.when(i % 4 == 0, "trustpilot").otherwise("reddit").alias("source"),
        "text",
        F.when(i % 8 == 0, (i % 5 + 1).cast("int")).alias("rating"),
        F.when(
            i % 10 != 0, F.timestamp_seconds(F.lit(1704067200) + (i * 7919) % 1209600)
        ).alias("published_at"),
        X.normalize("text").alias("norm"),
    ).withColumn("matched_terms", X.match_terms("norm", DOC_TERMS, normalized=True))


# Words are split where neither a letter, a digit nor an underscore stands.
WORDS_SQL = "string_split_regex({t}, '[^\\w\\p{{L}}\\p{{N}}]+')"
SQL["docm"] = f"""docm AS (
  SELECT doc_id, substr(sha256(src || chr(10) || doc_id), 1, 24) AS mention_id, *
    EXCLUDE (doc_id),
    list_filter(hits, lambda w, i: list_position(hits, w) = i) AS terms
  FROM (SELECT *, list_filter(words, lambda w: w IN ('the', 'of', 'und', 'la', 'que')) AS hits FROM (
    SELECT d.doc_id, d.source AS src, d.lang AS brand, d.text, {norm_sql('d.text')} AS norm,
      {WORDS_SQL.format(t=norm_sql('d.text'))} AS words,
      CASE WHEN d.doc_id % 4 = 0 THEN 'trustpilot' ELSE 'reddit' END AS source,
      CASE WHEN d.doc_id % 8 = 0 THEN d.doc_id % 5 + 1 END AS rating,
      CASE WHEN d.doc_id % 10 <> 0 THEN 1704067200 + (d.doc_id * 7919) % 1209600 END AS ts,
      CASE WHEN d.doc_id % 29 = 0 THEN 'refused' ELSE 'ok' END AS c_status,
      CASE WHEN d.doc_id % 37 = 0 THEN 'irrelevant' WHEN l.toxic = 1 THEN 'negative'
        WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS c_label,
      d.doc_id % 31 <> 0 AS c_about,
      0.5 + (d.doc_id % 50) / 100.0::DOUBLE AS c_conf,
      d.doc_id % 41 = 0 AS c_cached,
      CASE WHEN d.doc_id % 43 = 0 THEN 'error' ELSE 'ok' END AS t_status,
      CASE d.doc_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'irrelevant'
        ELSE 'neutral' END AS t_label,
      0.7 + (d.doc_id % 20) / 100.0::DOUBLE AS t_conf
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)))"""
# The deterministic signal of each document.
SQL["sig"] = f"""sig AS (
  SELECT *, CASE WHEN rated THEN 'rating' WHEN up + down > 0 THEN 'lexicon' ELSE 'none' END AS s_kind,
    CASE WHEN rated THEN CASE WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive'
        ELSE 'neutral' END
      WHEN up > down THEN 'positive' WHEN up < down THEN 'negative' END AS s_label
  FROM (SELECT *, source = 'trustpilot' AND rating IS NOT NULL AS rated,
      len(list_filter(words, lambda w: w IN {DOC_LEX_POS})) AS up,
      len(list_filter(words, lambda w: w IN {DOC_LEX_NEG})) AS down
    FROM docm))"""


# -- lineitem and orders as run ledger and billing list -------------------------------------------
def runs_log(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One line of the append-only log per row; later dates are later lines."""
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    k = F.col("l_orderkey")
    return li.select(
        k.alias("local_seq"),
        F.when(k % 17 != 0, k.cast("string")).alias("run_id"),
        F.when(k % 13 == 0, "elevenlabs").otherwise("apify").alias("provider"),
        _cycle(k % 4, EVENT_SOURCES).alias("source"),
        (F.col("l_partkey") % 500).cast("string").alias("input_digest"),
        F.col("l_shipdate").cast("timestamp").alias("submitted_at"),
        F.when(F.col("l_returnflag") == "R", "FAILED")
        .when((F.col("l_linestatus") == "O") & (k % 17 == 0), "LOCAL_DEADLINE")
        .when(F.col("l_linestatus") == "O", "PENDING")
        .otherwise("COMPLETED")
        .alias("status"),
        F.lit(200).alias("provider_http_status"),
        (F.col("l_quantity").cast("long") % 5).alias("n_results"),
        F.when(k % 17 == 0, 0.0).alias("cost_usd"),
        F.lit(None).cast("long").alias("billed_units"),
        F.when(k % 17 == 0, "local").otherwise("unreconciled").alias("cost_source"),
        F.struct(
            "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "l_returnflag", "l_linestatus", "l_quantity",
        ).alias("write_seq"),
    )


LOG_ORDER = (
    "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC,"
    " l_returnflag DESC, l_linestatus DESC, l_quantity DESC"
)
SQL["log"] = """log AS (
  SELECT l_orderkey AS local_seq,
    CASE WHEN l_orderkey % 17 <> 0 THEN l_orderkey::VARCHAR END AS run_id,
    CASE WHEN l_orderkey % 13 = 0 THEN 'elevenlabs' ELSE 'apify' END AS provider,
    CASE l_orderkey % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'news'
      ELSE 'google_maps' END AS source,
    (l_partkey % 500)::VARCHAR AS input_digest, l_shipdate AS submitted_at,
    CASE WHEN l_returnflag = 'R' THEN 'FAILED'
      WHEN l_linestatus = 'O' AND l_orderkey % 17 = 0 THEN 'LOCAL_DEADLINE'
      WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS status,
    l_quantity::BIGINT % 5 AS n_results,
    CASE WHEN l_orderkey % 17 = 0 THEN 0.0 END AS cost_usd,
    CASE WHEN l_orderkey % 17 = 0 THEN 'local' ELSE 'unreconciled' END AS cost_source,
    l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus,
    l_quantity
  FROM lineitem)"""
SQL["ledger"] = f"""ledger AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_seq ORDER BY {LOG_ORDER}) AS rn
    FROM log) WHERE rn = 1)"""


def runs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's billing list. Some runs are missing, some have an id the ledger lacks."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.when(k % 5 == 0, F.concat(F.lit("y"), k.cast("string")))
        .when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string")))
        .otherwise(k.cast("string"))
        .alias("run_id"),
        F.when(k % 19 != 0, F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.when(k % 11 != 0, F.col("o_totalprice") / 1000000.0).alias("cost_usd"),
        (k % 9).alias("billed_units"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "P", "FAILED")
        .alias("status"),
        F.when(k % 3 == 0, 503).cast("int").alias("provider_http_status"),
        k.alias("list_seq"),
    )


STARTED, RECONCILED = datetime(1995, 1, 1), datetime(2002, 1, 1)
SQL["list"] = """list AS (
  SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'y' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS run_id,
    CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate END AS created_at,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000000.0 END AS cost_usd,
    o_orderkey % 9 AS billed_units,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 503 END AS http
  FROM orders),
inwin AS (SELECT * FROM list WHERE created_at IS NULL OR
    (created_at >= TIMESTAMP '1994-12-31 23:59:00' AND created_at <= TIMESTAMP '2002-01-01 00:01:00')),
settled AS (
  SELECT l.local_seq, l.run_id, l.provider, l.source, l.n_results, l.input_digest, l.submitted_at,
    CASE WHEN r.cost_usd IS NOT NULL THEN r.cost_usd ELSE l.cost_usd END AS cost_usd,
    CASE WHEN r.cost_usd IS NOT NULL THEN r.billed_units END AS billed_units,
    CASE WHEN r.cost_usd IS NOT NULL THEN coalesce(r.status, l.status) ELSE l.status END AS status,
    CASE WHEN r.cost_usd IS NOT NULL THEN coalesce(r.http, 200) ELSE 200 END AS http,
    CASE WHEN r.cost_usd IS NOT NULL THEN '/v1/runs' ELSE l.cost_source END AS cost_source
  FROM ledger l LEFT JOIN inwin r ON l.run_id = r.run_id)"""


# -- embeddings as mention vectors ----------------------------------------------------------------
# A twentieth of the pairs of a brand are closer than this.
VEC_DIMS, VEC_CUT = 64, 0.8


def vec_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return v.select(
        F.format_string("%06d", i).alias("mention_id"),
        F.concat(F.lit("brand"), (i % 4).cast("string")).alias("brand"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.floor(i / 3).cast("string").alias("cluster_key"),
        F.when(i % 3 == 0, "positive").when(i % 3 == 1, "negative").otherwise("irrelevant").alias("label"),
        F.lit("ok").alias("status"),
        F.lit(True).alias("about_brand"),
        F.array(F.lit("t")).alias("matched_terms"),
    )


SQL["vec"] = """vec0 AS (
  SELECT vec_id, lpad(vec_id::VARCHAR, 6, '0') AS mention_id, 'brand' || (vec_id % 4) AS brand,
    (vec_id // 3)::VARCHAR AS cluster_key,
    CASE vec_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'irrelevant' END AS label,
    list_transform(embedding, lambda x: x::DOUBLE) AS raw
  FROM embeddings),
vec AS (
  SELECT *, list_transform(raw, lambda x: x / CASE WHEN list_dot_product(raw, raw) = 0 THEN 1.0
    ELSE sqrt(list_dot_product(raw, raw)) END) AS u FROM vec0)"""
