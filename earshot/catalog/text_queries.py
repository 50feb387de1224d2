"""Text, identity, dedup and count queries over documents, pages and conversations."""

from pyspark.sql import functions as F

from earshot import config
from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.functions import numbers as N
from earshot.functions import scalars as S
from earshot.functions import text as X
from earshot.functions import word_lists
from earshot.operators import counts as C
from earshot.operators import dedup as D
from earshot.operators.ranking import keep_first

NORM = V.norm_sql()


def docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def words_in(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


@query("f01_normalize", f"SELECT doc_id, md5({NORM}) AS norm FROM documents")
def normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalize("text")).alias("norm"))


@query("f03_text_key", f"SELECT doc_id, substr({NORM}, 1, 200) AS text_key FROM documents")
def text_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.text_key("text").alias("text_key"))


@query(
    "f36_normalize_term",
    r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS term"
    " FROM documents",
)
def normalize_term(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_term("text")).alias("term"))


_TRACK = words_in(config.TRACKING_PARAMS)
URL_SQL = f"""(SELECT page_id, html, path_brand, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url
  FROM (SELECT page_id, html, split_part(url, '/', 4) AS path_brand,
    lower(regexp_extract(url, '^[^:]+://[^/?#]*'))
      || CASE WHEN rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/'
         ELSE rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') END AS base,
    array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN {_TRACK}), '&') AS q
    FROM pages))"""


@query("f02_normalize_url", f"SELECT page_id, url FROM {URL_SQL}")
def normalize_url(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", X.normalize_url("url").alias("url"))


@query(
    "f04_mention_id",
    f"SELECT doc_id, substr(sha256(source || chr(10) || coalesce(CASE WHEN doc_id % 3 = 0 THEN"
    f" doc_id::VARCHAR END, substr({NORM}, 1, 200))), 1, 24) AS mention_id FROM documents",
)
def mention_id(spark, sf_dir):
    native = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string"))
    text = F.when(native.isNull(), F.col("text"))
    key = F.coalesce(native, X.text_key(text))
    return docs(spark, sf_dir).select("doc_id", S.mention_id("source", key).alias("mention_id"))


@query(
    "f06_input_digest",
    """SELECT o_orderkey, substr(sha256('{"custkey":' || o_custkey || ',"priority":"'
  || o_orderpriority || '","status":"' || o_orderstatus || '"}'), 1, 24) AS digest FROM orders""",
)
def input_digest(spark, sf_dir):
    body = F.struct(
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.input_digest(body).alias("digest"))


_PT, _EN = words_in(word_lists.STOP_PT), words_in(word_lists.STOP_EN)
LANG_SQL = f"""(SELECT doc_id, CASE WHEN n < 5 THEN 'unknown'
    WHEN pt / n > 0.1 AND en / n > 0.1 THEN CASE WHEN pt >= 2 * en THEN 'pt' WHEN en >= 2 * pt
      THEN 'en' ELSE 'other' END
    WHEN pt / n > 0.1 THEN 'pt' WHEN en / n > 0.1 THEN 'en' ELSE 'other' END AS detected
  FROM (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN {_PT})) AS pt,
    len(list_filter(w, lambda x: x IN {_EN})) AS en
    FROM (SELECT doc_id, regexp_extract_all({NORM}, '[a-zà-ú]+') AS w FROM documents)))"""


@query("f07_detect_lang", f"SELECT doc_id, detected FROM {LANG_SQL}")
def detect_lang(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.detect_lang("text").alias("detected"))


@query(
    "f08_match_terms",
    V.with_("docm") + "SELECT doc_id, array_to_string(terms, ',') AS terms FROM docm",
)
def match_terms(spark, sf_dir):
    found = X.match_terms("text", V.DOC_TERMS)
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("terms"))


@query(
    "f09_lexicon_score",
    V.with_("docm", "sig") + "SELECT doc_id, up + down AS n_hits, up - down AS score,"
    " CASE WHEN up > down THEN 'positive' WHEN up < down THEN 'negative' END AS sign FROM sig",
)
def lexicon_score(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", X.lexicon_score("text", V.DOC_LEXICON).alias("s"))
    return d.select("doc_id", "s.n_hits", "s.score", "s.sign")


@query(
    "f10_rating_bucket",
    "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l_linenumber <= 2 THEN 'negative' WHEN"
    " l_linenumber >= 4 THEN 'positive' ELSE 'neutral' END AS bucket FROM lineitem) GROUP BY ALL",
)
def rating_bucket(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    bucket = X.rating_bucket("l_linenumber").alias("bucket")
    return li.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_deterministic_signal",
    V.with_("docm", "sig") + "SELECT doc_id, s_kind AS kind, s_label AS label FROM sig",
)
def deterministic_signal(spark, sf_dir):
    m = V.doc_mentions(spark, sf_dir)
    signal = X.deterministic_signal("source", "rating", "norm", V.DOC_LEXICON, normalized=True)
    return m.select("doc_id", signal.alias("s")).select("doc_id", "s.kind", "s.label")


@query(
    "f13_cluster_key",
    """SELECT source, count(*) AS n, count(DISTINCT ck) AS keys, count(*) FILTER (fb) AS fallbacks
FROM (SELECT source, CASE WHEN source = 'tiktok' THEN coalesce(author, mid)
      WHEN source = 'news' THEN mid ELSE coalesce(parent, mid) END AS ck,
    source IN ('reddit', 'youtube_comment') AND parent IS NULL AS fb
  FROM (SELECT 'm' || conv_id || '-' || turn AS mid,
    CASE turn % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'news'
      ELSE 'youtube_comment' END AS source,
    CASE WHEN turn % 3 = 0 THEN role END AS author,
    CASE WHEN conv_id % 5 <> 0 THEN conv_id::VARCHAR END AS parent FROM conversations))
GROUP BY source""",
)
def cluster_key(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id")
    rows = V.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("m"), c.cast("string"), F.lit("-"), t.cast("string")).alias("mid"),
        V._cycle(t % 4, ("reddit", "tiktok", "news", "youtube_comment")).alias("source"),
        F.when(t % 3 == 0, F.col("role")).alias("author"),
        F.when(c % 5 != 0, c.cast("string")).alias("parent"),
    )
    keyed = rows.select(
        "source",
        S.cluster_key("source", "mid", "author", "parent").alias("ck"),
        S.cluster_key_fell_back("source", "parent").alias("fb"),
    )
    return keyed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ck").alias("keys"),
        F.count_if("fb").alias("fallbacks"),
    )


@query("f17_quote", "SELECT doc_id, substr(text, 1, 240) AS quote FROM documents")
def quote(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.quote("text").alias("quote"))


@query(
    "f18_first_words",
    r"SELECT doc_id, array_to_string(list_slice(string_split_regex(trim(regexp_replace(text,"
    r" '\s+', ' ', 'g')), ' '), 1, 6), ' ') AS words FROM documents",
)
def first_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.first_words("text", 6).alias("words"))


@query(
    "f18_clip_rationale",
    r"""SELECT doc_id, substr(CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') ELSE text END,
  1, 200) AS rationale FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'),
    lambda x: x <> '') AS w FROM documents)""",
)
def clip_rationale(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.clip_rationale("text").alias("rationale"))


@query(
    "f22_extract_numbers",
    """SELECT o_orderkey AS doc_id, 3 AS n, round(floor(o_totalprice)::BIGINT + 1234.5 + o_orderkey % 100, 6)
  AS total FROM orders""",
)
def extract_numbers(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    text = F.format_string(
        "paid %d of 1,234.50 or %d%% on %s",
        F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 100,
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    found = N.extract_numbers(N.clean_for_numbers(text))
    total = F.aggregate(found, F.lit(0.0), lambda acc, t: acc + t["value"].cast("double"))
    return o.select(
        F.col("o_orderkey").alias("doc_id"), F.size(found).alias("n"),
        F.round(total, 6).alias("total"),
    )


@query(
    "f23_round_half_up",
    "SELECT l_quantity AS q, l_discount AS d, round(l_quantity::DECIMAL(20,4) * 0.125, 2)::DOUBLE AS r"
    " FROM lineitem GROUP BY ALL",
)
def round_half_up(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.lit(1).alias("x"))
    value = F.col("l_quantity").cast("decimal(20,4)") * F.lit("0.125").cast("decimal(4,3)")
    return li.select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
        S.round_half_up(value, 2).cast("double").alias("r"),
    )


@query(
    "f24_strip_citations",
    """SELECT doc_id, 'see ' || source || '.' AS answer FROM documents""",
)
def strip_citations(spark, sf_dir):
    i = F.md5(F.col("doc_id").cast("string"))
    cited = F.substring(i, 1, 24)
    text = F.concat(F.lit("see "), "source", F.lit(" [ "), cited, F.lit(" ] "), cited, F.lit(" ."))
    d = docs(spark, sf_dir)
    return d.select("doc_id", N.strip_citations(text, F.array(cited)).alias("answer"))


_SECRETS = [p.replace("(?U)", "") for p in config.SECRET_PATTERNS]


def _redact_sql(column):
    for p in _SECRETS:
        column = f"regexp_replace({column}, '{p}', '{config.REDACTED}', 'g')"
    return column


@query(
    "f25_redact",
    f"SELECT doc_id, md5({_redact_sql('text')}) AS text, 'a ' || '{config.REDACTED} z' AS planted"
    " FROM documents",
)
def redact(spark, sf_dir):
    planted = F.concat(F.lit("a Bearer "), F.md5("text"), F.lit(" z"))
    return docs(spark, sf_dir).select(
        "doc_id", F.md5(X.redact("text")).alias("text"), X.redact(planted).alias("planted")
    )


@query(
    "f25_redact_map",
    f"SELECT doc_id, '{config.REDACTED}' AS token, source FROM documents",
)
def redact_map(spark, sf_dir):
    m = F.create_map(F.lit("access_token"), F.md5("text"), F.lit("source"), F.col("source"))
    d = docs(spark, sf_dir).select("doc_id", X.redact_map(m).alias("m"))
    return d.select("doc_id", F.col("m")["access_token"].alias("token"), F.col("m")["source"].alias("source"))


# -- dedup ----------------------------------------------------------------------------------------
_DEDUP = V.with_("doc") + """, k AS (SELECT *, CASE WHEN native_id IS NOT NULL THEN 'dedup_native_id'
    WHEN url IS NOT NULL THEN 'dedup_url' ELSE 'dedup_text' END AS rule,
  coalesce(native_id, url, substr(norm, 1, 200)) AS key FROM doc),
dd AS (SELECT *, row_number() OVER w AS rk, first_value(seq || '#' || doc_id) OVER w AS winner_ref
  FROM k WINDOW w AS (PARTITION BY source, brand, rule, key ORDER BY seq, doc_id))
"""


@query(
    "w03_dedup",
    _DEDUP + "SELECT doc_id, CASE WHEN rk > 1 THEN rule END AS reason, winner_ref FROM dd",
)
def dedup(spark, sf_dir):
    return D.dedup(V.doc_items(spark, sf_dir)).select("doc_id", "reason", "winner_ref")


_PAGE_ROWS = f"""p AS (SELECT page_id, 1 AS seq, path_brand AS brand, url FROM {URL_SQL}
  UNION ALL SELECT page_id, 2, path_brand, url FROM {URL_SQL})"""


@query(
    "w03_dedup_urls",
    f"""WITH {_PAGE_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY brand, url
  ORDER BY seq, page_id) AS rk FROM p)
SELECT brand, count(*) FILTER (rk = 1) AS kept, count(*) FILTER (rk > 1) AS dropped FROM r GROUP BY brand""",
)
def dedup_urls(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    joiner = F.when(F.col("url").contains("?"), "&").otherwise("?")
    tagged = F.concat(
        F.regexp_replace("url", "#.*$", ""), joiner, F.lit("utm_source=x")
    )
    item = lambda url, seq: p.select(
        F.lit("news").alias("source"),
        F.regexp_extract("url", "^[^:]+://[^/]+/([^/?#]*)", 1).alias("brand"),
        F.lit(None).cast("string").alias("native_id"),
        url.alias("url"),
        F.lit("page").alias("text"),
        F.concat(F.lit(f"{seq}#"), F.col("page_id").cast("string")).alias("raw_ref"),
    )
    both = item(F.col("url"), 1).unionByName(item(tagged, 2))
    return D.dedup(both).groupBy("brand").agg(
        F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("dropped"),
    )


@query(
    "q07_repeated_keys",
    "SELECT substr(sha256(source || chr(10) || (doc_id - doc_id % 6)), 1, 24) AS mention_id,"
    " lang AS brand, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def repeated_keys(spark, sf_dir):
    i = F.col("doc_id")
    m = docs(spark, sf_dir).select(
        S.mention_id("source", (i - i % 6).cast("string")).alias("mention_id"),
        F.col("lang").alias("brand"),
    )
    return D.repeated_keys(m)


@query(
    "w01_keep_first",
    f"SELECT {NORM} AS norm, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source"
    " FROM documents GROUP BY ALL",
)
def keep_first_text(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", X.normalize("text").alias("norm"))
    return keep_first(d, ["norm"], ["doc_id"])


# -- counts ---------------------------------------------------------------------------------------
_COUNTS = V.with_("doc") + f""", m AS (SELECT brand, source, detected AS lang,
    CASE WHEN doc_id % 4 = 0 THEN 'entity' ELSE 'text' END AS match_kind
  FROM doc JOIN {LANG_SQL} USING (doc_id))
SELECT 'brand' AS dimension, brand AS value, count(*) AS n FROM m GROUP BY brand
UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM m GROUP BY lang
UNION ALL SELECT 'match_kind', match_kind, count(*) FROM m GROUP BY match_kind"""


@query("a01_mention_counts", _COUNTS)
def mention_counts(spark, sf_dir):
    m = docs(spark, sf_dir).select(
        F.col("lang").alias("brand"), "source", X.detect_lang("text").alias("lang"),
        F.when(F.col("doc_id") % 4 == 0, "entity").otherwise("text").alias("match_kind"),
    )
    return C.mention_counts(m)


@query(
    "a02_funnel",
    _DEDUP + """, o AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'refused' ELSE 'ok' END AS status,
    doc_id % 31 <> 0 AS about_brand, doc_id % 37 = 0 AS irr FROM documents WHERE doc_id % 53 <> 0),
j AS (SELECT dd.*, o.status, o.about_brand, o.irr FROM dd LEFT JOIN o USING (doc_id) WHERE rk = 1)
SELECT (SELECT count(*) FROM doc) AS fetched, count(*) AS deduped,
  count(*) FILTER (status = 'ok') AS labelled, count(*) FILTER (status IS NULL) AS unlabelled,
  count(*) FILTER (status = 'ok' AND NOT about_brand) AS not_about_brand,
  count(*) FILTER (status = 'ok' AND about_brand AND irr) AS irrelevant_label,
  count(*) FILTER (status = 'refused') AS refused, 0 AS unparseable, 0 AS error,
  (SELECT count(*) FROM dd WHERE rk > 1 AND rule = 'dedup_native_id') AS dedup_native_id,
  (SELECT count(*) FROM dd WHERE rk > 1 AND rule = 'dedup_url') AS dedup_url,
  (SELECT count(*) FROM dd WHERE rk > 1 AND rule = 'dedup_text') AS dedup_text FROM j""",
)
def funnel(spark, sf_dir):
    items = V.doc_items(spark, sf_dir)
    done = D.dedup(items).withColumn(
        "mention_id", S.mention_id("source", F.col("doc_id").cast("string"))
    )
    labels = V.doc_observations(spark, sf_dir).filter(F.col("doc_id") % 53 != 0)
    return C.funnel(items, D.kept(done), labels, D.dropped(done))
