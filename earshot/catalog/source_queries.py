"""Source queries: the given tables written as provider items, then read back as mentions."""

from pyspark.sql import functions as F

from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.catalog.text_queries import URL_SQL
from earshot.functions import scalars as S
from earshot.functions import text as X
from earshot.functions import word_lists
from earshot.operators import counts as C
from earshot.operators import frame as R
from earshot.operators import terms as D
from earshot.settings import store
from earshot.sources import normalise as M
from earshot.sources import payloads as P
from earshot.sources import runs as N
from earshot.sources import tables as T

BRAND = "the"
TERMS = {BRAND: list(V.DOC_TERMS[1:])}
_T0 = 1704067200


def as_items(rows, source, item, local_seq, index):
    """Rows with a struct ``item`` as payload items; a null field is written, as one left out would be drift."""
    return rows.select(
        local_seq.cast("long").alias("local_seq"),
        F.concat(F.lit("run-"), local_seq.cast("string")).alias("run_id"),
        F.lit(BRAND).alias("brand"),
        F.lit(source).alias("source"),
        F.lit(False).alias("no_list"),
        index.alias("index"),
        F.parse_json(F.to_json(item, {"ignoreNullFields": "false"})).alias("item"),
    )


def text_of(prefix):
    return lambda value: F.concat(F.lit(prefix), value.cast("string"))


def items(spark, sf_dir, source):
    d = V.table(spark, sf_dir, "documents")
    a = lambda value, name: value.alias(name)
    lang, doc = F.col("lang"), F.col("doc_id")
    iso = F.date_format(F.timestamp_seconds(F.lit(_T0) + doc * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = {
        "youtube": [
            a(text_of("v")(doc), "id"), a(F.col("source"), "title"), a(F.col("text"), "text"),
            a(lang, "channelName"), a(iso, "date"), a(F.format_number(doc * 1000 + 5, 0), "viewCount"),
            a(doc, "likes"), a(F.lit(-1), "commentsCount"),
        ],
        "youtube_comment": [
            a(F.when(doc % 3 != 0, text_of("c")(doc)), "cid"), a(F.col("text"), "comment"),
            a(text_of("v")(doc % 50), "videoId"), a(lang, "author"), a(doc, "voteCount"),
        ],
        "tiktok": [
            a(doc, "id"), a(F.col("text"), "caption"), a(doc, "views"), a(F.lit(_T0) + doc * 60, "uploadedAt"),
            a(text_of("https://TikTok.com/@x/")(doc), "postPage"),
            a(F.struct(lang.alias("username")), "channel"),
        ],
        "instagram": [
            a(text_of("s")(doc), "shortCode"), a(F.col("text"), "caption"), a(doc, "likesCount"),
            a(F.when(doc % 4 != 0, lang), "ownerUsername"),
        ],
        "google_maps": [
            a(text_of("r")(doc), "reviewId"), a(F.col("text"), "text"),
            a(F.when(doc % 101 == 0, 7).otherwise((doc % 5 + 1).cast("int")), "stars"),
            a(iso, "publishedAtDate"), a(text_of("https://maps.example.com/r/")(doc), "reviewUrl"),
            a(lang, "name"), a(doc, "likesCount"),
        ],
        "facebook": [
            a(text_of("f")(doc), "id"), a(F.col("text"), "text"), a(iso, "date"),
            a(doc % 2 == 0, "isRecommended"), a(doc, "likesCount"), a(F.struct(lang.alias("name")), "user"),
            a(F.when(doc % 50 == 0, "not found"), "error"),
        ],
        "trustpilot": [
            a(text_of("t")(doc), "id"), a(F.col("source"), "title"), a(F.col("text"), "content"),
            a((doc % 5 + 1).cast("string"), "stars"), a(iso, "createdAt"),
            a(F.struct(lang.alias("displayName")), "consumer"),
            a(F.struct(text_of("https://t.example.com/")(doc).alias("url")), "source"),
        ],
        "g2": [
            a(text_of("g")(doc), "reviewId"), a(F.col("source"), "title"), a(F.col("text"), "text"),
            a((doc % 5 + 1).cast("double"), "rating"), a(iso, "date"),
            a(F.struct(lang.alias("name")), "reviewer"), a(text_of("https://g.example.com/")(doc), "url"),
        ],
    }[source]
    item = F.struct(*fields)
    return as_items(d, source, item, doc % 97 + 1, doc)


def shown(mentions):
    return mentions.select(
        "mention_id", "native_id", "url", "author_hash", F.md5("text").alias("text"),
        F.unix_timestamp("published_at").alias("at"),
        S.engagement_score("engagement").alias("engagement"),
        F.col("rating").cast("long").alias("rating"), "cluster_key",
        F.array_join("matched_terms", ",").alias("terms"), "match_kind", "raw_ref",
    )


_STRIP = r"regexp_replace(text, '^\s+|\s+$', 'g')"
_TITLED = f"src || chr(10) || chr(10) || {_STRIP}"


def oracle(
    source, native="NULL", url="NULL", handle="brand", at="NULL", engagement="0", rating="NULL",
    cluster="mid", text="text", key=None, where="true", entity=False, strip=False,
):
    """Expected mentions, computed from the documents directly."""
    terms = "'the'" if entity else "array_to_string(terms, ',')"
    keep = where if entity else f"len(terms) > 0 AND {where}"
    return V.with_("docm") + f""", x AS (SELECT *, {native} AS native, {url} AS link, {at} AS at_,
    substr(sha256('{source}' || chr(10) || {handle}), 1, 16) AS ah FROM docm WHERE {keep}),
y AS (SELECT *, substr(sha256('{source}' || chr(10) || {key or 'native'}), 1, 24) AS mid FROM x)
SELECT mid AS mention_id, native AS native_id, link AS url, ah AS author_hash, md5({text}) AS text,
  at_ AS at, ({engagement})::BIGINT AS engagement, {rating} AS rating, {cluster} AS cluster_key,
  {terms} AS terms, '{'entity' if entity else 'text'}' AS match_kind,
  (doc_id % 97 + 1) || '#' || doc_id AS raw_ref FROM y"""


_AT = f"{_T0} + doc_id * 60"


def mentions_of(source, whole_run=False):
    def run(spark, sf_dir):
        return shown(M.mentions(M.parse(items(spark, sf_dir, source), source, TERMS), whole_run))

    return run


query("src03_youtube", oracle(
    "youtube", "'v' || doc_id", "'https://www.youtube.com/watch?v=v' || doc_id", at=_AT,
    engagement="doc_id * 1000 + 5 + doc_id", text="src || chr(10) || chr(10) || text",
))(mentions_of("youtube"))
query("src04_youtube_comment", oracle(
    "youtube_comment", "CASE WHEN doc_id % 3 <> 0 THEN 'c' || doc_id END",
    key="coalesce(native, substr(norm, 1, 200))", engagement="doc_id", cluster="'v' || (doc_id % 50)",
))(mentions_of("youtube_comment"))
query("src05_tiktok", oracle(
    "tiktok", "doc_id::VARCHAR", "'https://tiktok.com/@x/' || doc_id", at=_AT, engagement="doc_id",
    cluster="ah",
))(mentions_of("tiktok"))
query("src06_instagram", oracle(
    "instagram", "'s' || doc_id", "'https://www.instagram.com/p/s' || doc_id",
    handle="CASE WHEN doc_id % 4 <> 0 THEN brand END", engagement="doc_id", cluster="coalesce(ah, mid)",
))(mentions_of("instagram"))
query("src07_google_maps", oracle(
    "google_maps", "'r' || doc_id", "'https://maps.example.com/r/' || doc_id", at=_AT,
    engagement="doc_id", rating="doc_id % 5 + 1", where="doc_id % 101 <> 0", entity=True,
))(mentions_of("google_maps"))
query("src08_facebook", oracle(
    "facebook", "'f' || doc_id", at=_AT, engagement="doc_id",
    rating="CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 1 END::BIGINT", where="doc_id % 50 <> 0", entity=True,
))(mentions_of("facebook"))
query("src09_trustpilot", oracle(
    "trustpilot", "'t' || doc_id", "'https://t.example.com/' || doc_id", at=_AT, text=_TITLED,
    rating="doc_id % 5 + 1", entity=True,
))(mentions_of("trustpilot"))
query("src10_g2", oracle(
    "g2", "'g' || doc_id", "'https://g.example.com/' || doc_id", at=_AT, text=_TITLED,
    rating="doc_id % 5 + 1", entity=True,
))(mentions_of("g2"))


# -- news from pages --------------------------------------------------------------------------------
_PAGE_NORM = V.norm_sql("full_text")


@query(
    "src11_news",
    f"""WITH p AS (SELECT u.page_id, u.url, p.html, regexp_extract(p.html, '<title>(.*?)</title>', 1)
    || chr(10) || chr(10) || p.html AS full_text, regexp_extract(p.url, '^[^:]+://([^/?#]*)', 1) AS site
  FROM {URL_SQL} u JOIN pages p USING (page_id)),
t AS (SELECT *, list_filter({V.WORDS_SQL.format(t=_PAGE_NORM)},
    lambda w: w IN ('the', 'of', 'und', 'la', 'que')) AS hits FROM p)
SELECT substr(sha256('news' || chr(10) || url), 1, 24) AS mention_id, url,
  substr(sha256('news' || chr(10) || site), 1, 16) AS author_hash,
  array_to_string(list_filter(hits, lambda w, i: list_position(hits, w) = i), ',') AS terms
FROM t WHERE len(hits) > 0""",
)
def news(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    item = F.struct(
        F.col("url"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("snippet"), F.lit("2024-01-05").alias("date"),
        F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("site_name"),
    )
    rows = as_items(p, "news", item, F.col("page_id") % 9 + 1, F.col("page_id"))
    got = M.mentions(M.parse(rows, "news", TERMS))
    return got.select(
        "mention_id", "url", "author_hash", F.array_join("matched_terms", ",").alias("terms")
    )


# -- reddit threads from conversations --------------------------------------------------------------
def thread_items(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    post = t == 0
    parent = F.concat(F.lit("t3_"), c.cast("string"))
    item = F.struct(
        F.when(post, "post").otherwise("comment").alias("dataType"),
        F.when(post, parent).otherwise(F.concat(F.lit("c"), c.cast("string"), F.lit("_"), t.cast("string"))).alias("id"),
        F.when(post, F.col("text")).alias("title"),
        F.when(~post, F.col("text")).alias("body"),
        F.when(~post & (c % 8 != 0), parent).alias("postId"),
        F.col("role").alias("username"),
        (F.lit(_T0) + t).alias("createdAt"),
        t.alias("upVotes"),
    )
    return as_items(V.table(spark, sf_dir, "conversations"), "reddit", item, c + 1, t)


_THREADS = f"""WITH c0 AS (SELECT *, list_filter({V.WORDS_SQL.format(t=V.norm_sql())},
    lambda w: w IN ('the', 'of', 'und', 'la', 'que')) AS hits FROM conversations),
c1 AS (SELECT conv_id, turn, list_filter(hits, lambda w, i: list_position(hits, w) = i) AS own FROM c0),
c2 AS (SELECT c.*, CASE WHEN len(c.own) = 0 AND c.turn > 0 AND c.conv_id % 8 <> 0 AND len(p.own) > 0
    THEN p.own END AS got FROM c1 c LEFT JOIN c1 p ON p.conv_id = c.conv_id AND p.turn = 0)"""


@query(
    "src02_reddit",
    _THREADS + """SELECT substr(sha256('reddit' || chr(10) || CASE WHEN turn = 0 THEN 't3_' || conv_id
    ELSE 'c' || conv_id || '_' || turn END), 1, 24) AS mention_id,
  CASE WHEN turn = 0 OR conv_id % 8 <> 0 THEN 't3_' || conv_id ELSE substr(sha256('reddit' || chr(10)
    || 'c' || conv_id || '_' || turn), 1, 24) END AS cluster_key,
  array_to_string(coalesce(got, own), ',') AS terms,
  CASE WHEN got IS NOT NULL THEN 'inherited' ELSE 'text' END AS match_kind, turn AS score
FROM c2 WHERE len(own) > 0 OR got IS NOT NULL""",
)
def reddit(spark, sf_dir):
    got = M.mentions(M.parse(thread_items(spark, sf_dir), "reddit", TERMS))
    return got.select(
        "mention_id", "cluster_key", F.array_join("matched_terms", ",").alias("terms"), "match_kind",
        S.engagement_score("engagement").alias("score"),
    )


@query(
    "j01_inherited_terms",
    _THREADS + "SELECT conv_id, turn, array_to_string(got, ',') AS terms FROM c2 WHERE got IS NOT NULL",
)
def inherited_terms(spark, sf_dir):
    got = M.parse(thread_items(spark, sf_dir), "reddit", TERMS).filter("match_kind = 'inherited'")
    return got.select(
        (F.col("local_seq") - 1).alias("conv_id"), F.col("index").alias("turn"),
        F.array_join("matched_terms", ",").alias("terms"),
    )


@query(
    "a26_parse_report",
    _THREADS + """SELECT 'reddit' AS source, count(*) FILTER (turn > 0 AND conv_id % 8 = 0 AND len(own) > 0)
  AS cluster_key_fallbacks, count(*) FILTER (len(own) = 0 AND got IS NULL) AS skipped_no_match,
  0 AS skipped_no_text FROM c2""",
)
def parse_report(spark, sf_dir):
    return C.parse_report(M.parse(thread_items(spark, sf_dir), "reddit", TERMS)).drop("brand")


# -- payload bodies, drift and errors ---------------------------------------------------------------
def bodies(spark, sf_dir):
    """One run body per document, in the different shapes providers use."""
    doc = F.col("doc_id")
    item = F.to_json(F.struct(text_of("v")(doc).alias("id"), F.col("text").alias("title")))
    wrap = (
        F.when(doc % 4 == 0, F.concat(F.lit('{"output":['), item, F.lit(","), item, F.lit("]}")))
        .when(doc % 4 == 1, F.concat(F.lit('{"output":{"items":['), item, F.lit("]}}")))
        .when(doc % 4 == 2, F.concat(F.lit("["), item, F.lit("]")))
        .otherwise(F.concat(F.lit('{"message":'), item, F.lit("}")))
    )
    return V.table(spark, sf_dir, "documents").select(
        (doc + 1).alias("local_seq"), F.lit("r").alias("run_id"), F.lit(BRAND).alias("brand"),
        F.lit("youtube").alias("source"), wrap.alias("body"),
    )


@query(
    "src01_payload_items",
    """SELECT doc_id + 1 AS local_seq, 0 AS index, 'v' || doc_id AS id FROM documents WHERE doc_id % 4 < 3
UNION ALL SELECT doc_id + 1, 1, 'v' || doc_id FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id + 1, NULL, NULL FROM documents WHERE doc_id % 4 = 3""",
)
def payload_items(spark, sf_dir):
    got = P.payload_items(bodies(spark, sf_dir))
    return got.select("local_seq", "index", P.string("item", "id").alias("id"))


class _Columns:
    """Adapter of a provider that sends one list for each field instead of one object for each item."""

    source = "columns"

    def items(self, body):
        import json

        fields = json.loads(body)["columns"]
        return [dict(zip(fields, values)) for values in zip(*fields.values())]


@query(
    "x01_run_folders",
    """SELECT 'columns' AS source, doc_id + 1 AS local_seq, 0 AS index, 'v' || doc_id AS id FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT 'columns', doc_id + 1, 1, 'w' || doc_id FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT 'youtube', doc_id + 1, 0, 'v' || doc_id FROM documents WHERE doc_id % 4 = 0""",
)
def run_folders(spark, sf_dir):
    """Run bodies in folders, read through the data source; a source of our own, and runs that no filter wants."""
    doc = F.col("doc_id")
    name = lambda prefix: F.concat(F.lit(prefix), doc.cast("string"))
    usual = F.to_json(F.struct(F.array(F.struct(name("v").alias("id"))).alias("output")))
    by_field = F.to_json(F.struct(F.struct(F.array(name("v"), name("w")).alias("id")).alias("columns")))
    d = V.table(spark, sf_dir, "documents")
    runs = d.select(
        (doc + 1).alias("local_seq"), name("r").alias("run_id"), F.lit(BRAND).alias("brand"),
        F.when(doc % 4 == 0, "youtube").when(doc % 4 == 1, "columns").when(doc % 4 == 2, "news").otherwise("tiktok").alias("source"),
        F.when(doc % 4 == 1, by_field).otherwise(usual).alias("body"),
    )
    path = T.fresh_path(spark, "runs")
    N.write_runs(runs.repartition(8), path)
    N.install(spark, [_Columns()])
    read = N.as_items(spark.read.format(N.FORMAT).load(path).filter(F.col("source").isin("columns", "youtube")))
    return read.select("source", "local_seq", "index", P.string("item", "id").alias("id"))


@query(
    "f37_result_count",
    "SELECT doc_id + 1 AS local_seq, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM documents",
)
def result_count(spark, sf_dir):
    return bodies(spark, sf_dir).select("local_seq", P.result_count().alias("n"))


@query(
    "src12_drift",
    """SELECT 'google_maps' AS source, doc_id AS index, 'stars is not an integer 1-5' AS reason
FROM documents WHERE doc_id % 101 = 0
UNION ALL SELECT 'youtube', NULL, 'no item list' FROM documents WHERE doc_id % 4 = 3""",
)
def drift(spark, sf_dir):
    maps = M.drifted(M.parse(items(spark, sf_dir, "google_maps"), "google_maps", TERMS))
    lists = M.drifted(M.parse(P.payload_items(bodies(spark, sf_dir)), "youtube", TERMS))
    pick = ["source", F.col("index").cast("long").alias("index"), "reason"]
    return maps.select(*pick).unionByName(lists.select(*pick))


@query(
    "src13_run_outcomes",
    """SELECT doc_id % 97 + 1 AS local_seq, CASE WHEN bool_and(doc_id % 50 = 0) THEN 'empty' ELSE 'none' END
  AS reason FROM documents GROUP BY ALL""",
)
def run_outcomes(spark, sf_dir):
    got = M.run_outcomes(M.parse(items(spark, sf_dir, "facebook"), "facebook", TERMS))
    return got.select("local_seq", F.coalesce("reason", F.lit("none")).alias("reason"))


@query(
    "u01_all_mentions",
    V.with_("docm") + """SELECT 'youtube' AS source, count(*) AS n FROM docm WHERE len(terms) > 0
UNION ALL SELECT 'tiktok', count(*) FROM docm WHERE len(terms) > 0
UNION ALL SELECT 'facebook', count(*) FROM docm WHERE doc_id % 50 <> 0""",
)
def all_mentions(spark, sf_dir):
    every = None
    for source in ("youtube", "tiktok", "facebook"):
        part = items(spark, sf_dir, source)
        every = part if every is None else every.unionByName(part)
    got = M.mentions(M.parse_all(every, TERMS))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# -- coverage ---------------------------------------------------------------------------------------
_PLANNED = ("reddit", "google_maps", "news", "tiktok", "g2")
_GRID = V.with_("ev") + """, b AS (SELECT DISTINCT brand FROM ev),
grid AS (SELECT brand, source FROM b, (VALUES ('reddit'), ('google_maps'), ('news'), ('tiktok'), ('g2')) s(source))"""


def _grid(spark, sf_dir):
    e = V.ev_labelled(spark, sf_dir)
    have = e.filter("source <> 'tiktok' or brand <> 'click'").select("brand", "source")
    return C.coverage_grid(
        e.select("brand").distinct(), list(_PLANNED), have, V.ev_abstentions(spark, sf_dir)
    ), have


@query(
    "j08_coverage_grid",
    _GRID + """SELECT brand, source, CASE WHEN source = 'tiktok' AND brand = 'click' THEN 'abstained'
  WHEN source = 'g2' THEN 'not_fetched' ELSE 'returned' END AS state,
  CASE WHEN source = 'tiktok' AND brand = 'click' THEN 'empty' END AS reason FROM grid""",
)
def coverage_grid(spark, sf_dir):
    return _grid(spark, sf_dir)[0]


@query(
    "a27_source_abstentions",
    _GRID + """SELECT brand, source, CASE WHEN source = 'g2' AND brand = 'view' THEN 'deadline'
  ELSE 'empty' END AS reason FROM grid WHERE source = 'g2' OR (source = 'tiktok' AND brand = 'click')""",
)
def source_abstentions(spark, sf_dir):
    grid, have = _grid(spark, sf_dir)
    counts = have.groupBy("brand", "source").agg(F.count(F.lit(1)).alias("n"))
    last = V.table(spark, sf_dir, "events").agg(F.max("event_type").alias("brand"))
    runs = last.select(
        "brand", F.lit("g2").alias("source"), F.lit(1).alias("local_seq"),
        F.lit("TIMED_OUT").alias("status"), F.lit(None).cast("int").alias("provider_http_status"),
    )
    return C.source_abstentions(grid, counts, runs).drop("scope")


@query(
    "j09_resolved_reviews",
    """SELECT lang AS brand, count(*) AS n, false AS abstained FROM documents WHERE lang IN ('en', 'fr')
GROUP BY ALL UNION ALL SELECT DISTINCT lang, 0, true FROM documents WHERE lang NOT IN ('en', 'fr')""",
)
def resolved_reviews(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("brand"), F.lit("g2").alias("source")
    )
    entity = F.when(F.col("brand").isin("en", "fr"), F.concat("brand", F.lit(".example.org")))
    entities = d.select("brand", "source", entity.alias("entity")).distinct()
    kept, lost = M.resolved_reviews(d, entities)
    have = kept.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).withColumn("abstained", F.lit(False))
    return have.unionByName(
        lost.select("brand", F.lit(0).cast("long").alias("n"), F.lit(True).alias("abstained"))
    )


@query(
    "u06_brand_terms",
    "SELECT DISTINCT lang AS brand, lang || ',src1' AS terms FROM documents",
)
def brand_terms(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("lang").alias("brand")).distinct()
    rows = D.brand_terms(d.withColumn("aliases", F.array("brand", F.lit("src1"), F.lit("src1"))))
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    listed = rows.groupBy("brand").agg(F.transform(ordered, lambda x: x["term"]).alias("terms"))
    return listed.select("brand", F.array_join("terms", ",").alias("terms"))


@query(
    "f08_term_table",
    """WITH d AS (SELECT doc_id, source AS brand, regexp_extract_all(""" + V.norm_sql() + """, '[\\w\\p{L}\\p{N}]+') AS toks FROM documents)
SELECT doc_id, len(list_distinct(list_filter(toks, lambda t: regexp_full_match(t, '[a-z]{3,}'))))::BIGINT AS n_terms,
  coalesce(list_filter(toks, lambda t: regexp_full_match(t, '[a-z]{3,}'))[1], '') AS first_term FROM d""",
)
def term_table(spark, sf_dir):
    """Each source is a brand whose terms are all plain words of its documents, some thousands."""
    d = store(V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("brand"), X.normalize("text").alias("norm")))
    words = F.array_distinct(F.regexp_extract_all("norm", F.lit("([a-z]{3,})"), F.lit(1)))
    plain = d.select("brand", F.explode(words).alias("alias")).distinct()
    terms = plain.select("brand", F.col("alias").alias("term"), F.char_length("alias").alias("place"))
    got = D.match_table(d, terms, ["doc_id"], "norm", normalized=True)
    n = F.size("matched_terms").cast("long")
    return got.select("doc_id", n.alias("n_terms"), F.coalesce(F.get("matched_terms", F.lit(0)), F.lit("")).alias("first_term"))


# -- lexicons and dimensions ------------------------------------------------------------------------
_LEX_VALUES = ", ".join(
    "('" + t.replace("'", "''") + f"', {p})" for t, p in sorted(word_lists.sentiment_terms().items())
)


@query(
    "src18_lexicon_use",
    f"""WITH lex(term, polarity) AS (VALUES {_LEX_VALUES}), w AS (SELECT doc_id,
  unnest(list_distinct({V.WORDS_SQL.format(t=V.norm_sql())})) AS term FROM documents)
SELECT polarity, count(*) AS n FROM w JOIN lex USING (term) GROUP BY polarity""",
)
def lexicon_use(spark, sf_dir):
    """Documents that contain a single-word lexicon term, by polarity; the lexicon is read from its file form."""
    path = T.fresh_path(spark, "lexicon")
    sign = F.when(F.col("polarity") > 0, "+").otherwise("-")
    T.default_lexicon(spark).select(F.concat(sign, F.lit("\t"), "term").alias("value")).write.text(path)
    lexicon = T.read_lexicon(spark, path).filter(~F.col("term").contains(" "))
    words = V.table(spark, sf_dir, "documents").select(
        F.explode(F.array_distinct(F.split(X.normalize("text"), r"(?U)[^\w]+"))).alias("term")
    )
    got = words.join(lexicon, "term").groupBy("polarity").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("polarity").cast("long").alias("polarity"), "n")
