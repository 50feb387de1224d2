"""Vector, topic and retrieval queries over embeddings."""

from pyspark.sql import functions as F

from earshot import config
from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.functions import scalars as S
from earshot.operators import topics as T
from earshot.operators import vectors as X

VEC = V.with_("vec")
_ARR = "list_transform({0}, lambda x: round(x, 9))"


def unit(spark, sf_dir):
    return X.with_unit_vectors(V.vec_mentions(spark, sf_dir))


@query("f33_unit_vector", VEC + "SELECT mention_id, " + ", ".join(f"round(u[{i}], 9) AS u{i}" for i in range(1, V.VEC_DIMS + 1)) + " FROM vec")
def unit_vector(spark, sf_dir):
    u = unit(spark, sf_dir)
    return u.select(
        "mention_id", *[F.round(F.col("unit")[i], 9).alias(f"u{i + 1}") for i in range(V.VEC_DIMS)]
    )


@query(
    "f34_cosine_distance",
    VEC + """SELECT a.mention_id, round(greatest(0, least(2, 1 - list_dot_product(a.u, b.u))), 9) AS d
FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark, sf_dir):
    u = unit(spark, sf_dir).select("mention_id", F.col("mention_id").cast("long").alias("i"), "unit")
    after = u.select((F.col("i") - 1).alias("i"), F.col("unit").alias("other"))
    return u.join(after, "i").select(
        "mention_id", F.round(S.cosine_distance("unit", "other"), 9).alias("d")
    )


_DIST = VEC + """, dv AS (SELECT brand, u, min(mention_id) AS cid, count(*) AS copies FROM vec GROUP BY ALL)"""


@query(
    "v01_close_pairs",
    _DIST + """SELECT x.brand, x.cid AS a, y.cid AS b,
  round(greatest(0, 1 - list_dot_product(x.u, y.u)), 8) AS distance, x.copies AS copies_a,
  y.copies AS copies_b FROM dv x JOIN dv y ON x.brand = y.brand AND x.cid < y.cid
WHERE 1 - list_dot_product(x.u, y.u) <= """ + str(V.VEC_CUT),
)
def close_pairs(spark, sf_dir):
    got = X.close_pairs(unit(spark, sf_dir), V.VEC_CUT)
    return got.withColumn("distance", F.round("distance", 8))


# One merge at a time, of the least pair of each brand, until none is within the cut; the rows of a brand's
# last step are its clusters.
_LINKAGE = VEC.replace("WITH ", "WITH RECURSIVE ", 1) + f""", st AS (
  SELECT 0 AS i, brand, min(mention_id) AS cid, count(*)::DOUBLE AS n, u AS m, list(mention_id) AS ids
  FROM vec GROUP BY brand, u
UNION ALL
  SELECT * FROM (WITH pair AS (SELECT a.brand, a.cid AS x, b.cid AS y,
        greatest(0, 1 - list_dot_product(a.m, b.m)) AS d FROM st a JOIN st b ON a.brand = b.brand AND a.cid < b.cid),
    best AS (SELECT brand, x, y FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY d, x, y) AS r
      FROM pair WHERE d <= {V.VEC_CUT}) WHERE r = 1)
  SELECT s.i + 1 AS i, s.brand, s.cid, s.n + coalesce(t.n, 0) AS n, CASE WHEN t.cid IS NULL THEN s.m ELSE
      list_transform(range(1, {V.VEC_DIMS + 1}), lambda k: (s.m[k] * s.n + t.m[k] * t.n) / (s.n + t.n)) END AS m,
    s.ids || coalesce(t.ids, []) AS ids
  FROM st s JOIN best ON best.brand = s.brand LEFT JOIN st t ON t.brand = s.brand AND s.cid = best.x AND t.cid = best.y
  WHERE s.cid <> best.y))
SELECT brand, unnest(ids) AS mention_id, cid FROM st JOIN (SELECT brand, max(i) AS i FROM st GROUP BY brand) USING (brand, i)"""


@query("v02_average_linkage", _LINKAGE)
def average_linkage(spark, sf_dir):
    return X.average_linkage(unit(spark, sf_dir), V.VEC_CUT)


@query("v02_average_linkage_rounds", _LINKAGE)
def average_linkage_rounds(spark, sf_dir):
    """The distributed rounds on every brand, whatever its size."""
    return X.average_linkage(unit(spark, sf_dir), V.VEC_CUT, block=256, small=0)


@query("v03_topics")
def topics(spark, sf_dir):
    m = V.vec_mentions(spark, sf_dir)
    got = T.build_topics(m.drop("vector"), m.select("brand", "mention_id", "vector"), V.VEC_CUT, b=config.B_LIVE)
    return got["topics"].withColumn("exemplar_mention_ids", F.array_join("exemplar_mention_ids", ","))


# Groups known in advance, so that the topic arithmetic can be checked elsewhere.
GRP = VEC + """, mem AS (SELECT *, lpad((vec_id // 4 % 5)::VARCHAR, 4, '0') AS cid FROM vec),
un AS (SELECT brand, cid, cluster_key, count(*) AS n, count(*) FILTER (label = 'positive') AS pos,
    count(*) FILTER (label = 'negative') AS neg, 0 AS neu FROM mem GROUP BY ALL),
ts AS (SELECT brand, cid, sum(n)::BIGINT AS n, count(*) AS n_clusters, sum(pos)::BIGINT AS pos,
    sum(neg)::BIGINT AS neg, 0 AS neu, count(*) FILTER (pos + neg > 0) AS polar_breadth
  FROM un GROUP BY ALL)"""


def members(spark, sf_dir):
    i = F.col("mention_id").cast("long")
    cid = F.format_string("%04d", F.floor(i / 4) % 5)
    return unit(spark, sf_dir).withColumn("cid", cid)


def sums(spark, sf_dir):
    m = members(spark, sf_dir)
    n = m.groupBy("brand").agg(F.count(F.lit(1)).alias("n_relevant"))
    return T.topic_sums(T.unit_counts(m), n)


@query(
    "a22_topic_aggregates",
    GRP + """SELECT brand, cid, n, n_clusters, pos, neg, polar_breadth,
  CASE WHEN pos + neg >= 3 AND polar_breadth >= 2 THEN
    round(n / sum(n) OVER (PARTITION BY brand), 9) END AS share,
  CASE WHEN pos + neg >= 3 AND polar_breadth >= 2 THEN
    round((pos - neg) / nullif(pos + neg + neu, 0), 9) END AS net FROM ts""",
)
def topic_aggregates(spark, sf_dir):
    return sums(spark, sf_dir).select(
        "brand", "cid", "n", "n_clusters", "pos", "neg", "polar_breadth",
        F.round("share", 9).alias("share"), F.round("net", 9).alias("net"),
    )


@query(
    "p07_topic_gate",
    GRP.replace("vec_id // 4 % 5", "vec_id // 16") + """SELECT brand, cid, n, n_clusters FROM ts
WHERE n >= 3 AND n_clusters >= 2""",
)
def topic_gate(spark, sf_dir):
    i = F.col("mention_id").cast("long")
    m = unit(spark, sf_dir).withColumn("cid", F.format_string("%04d", F.floor(i / 16)))
    n = m.groupBy("brand").agg(F.count(F.lit(1)).alias("n_relevant"))
    return T.gated(T.topic_sums(T.unit_counts(m), n)).select("brand", "cid", "n", "n_clusters")


@query(
    "w10_topic_index",
    GRP + """SELECT brand, cid, brand || '-' || lpad(idx::VARCHAR, 2, '0') AS topic_id, idx FROM (SELECT *,
  row_number() OVER (PARTITION BY brand ORDER BY n DESC, n_clusters DESC, cid) AS idx FROM ts)""",
)
def topic_index(spark, sf_dir):
    return T.numbered(sums(spark, sf_dir)).select("brand", "cid", "topic_id", "idx")


@query(
    "f19_topic_names",
    GRP + """SELECT cid, brand || ' topic ' || lpad((row_number() OVER (PARTITION BY brand
  ORDER BY n DESC, n_clusters DESC, cid))::VARCHAR, 2, '0') AS name FROM ts""",
)
def topic_names(spark, sf_dir):
    got = T.numbered(sums(spark, sf_dir))
    return got.select("cid", T.fallback_name(F.col("brand"), F.col("idx")).alias("name"))


@query(
    "f14_brand_slug",
    "SELECT DISTINCT lang, 'caf-' || lang || '-co' AS slug FROM documents",
)
def brand_slugs(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("lang").distinct()
    return d.select("lang", T.slug(F.concat(F.lit("Caf "), F.upper("lang"), F.lit(" & Çó."))).alias("slug"))


_MED = GRP + ", ce AS (SELECT brand, cid, [" + ", ".join(f"avg(u[{i}])" for i in range(1, V.VEC_DIMS + 1)) + """] AS c
  FROM mem GROUP BY ALL),
cn AS (SELECT brand, cid, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM ce)"""


@query(
    "w11_medoids",
    _MED + """SELECT brand, cid, mention_id, round(d, 8) AS distance, rank FROM (SELECT brand, cid,
  mention_id, 1 - list_dot_product(u, c) AS d, row_number() OVER (PARTITION BY brand, cid
    ORDER BY 1 - list_dot_product(u, c), mention_id) AS rank FROM mem JOIN cn USING (brand, cid))
WHERE rank <= 3""",
)
def medoids(spark, sf_dir):
    got = X.medoids(members(spark, sf_dir))
    return got.withColumn("distance", F.round("distance", 8))


@query(
    "b07_topic_intervals",
    GRP + """, ui AS (SELECT *, row_number() OVER (PARTITION BY brand, cid ORDER BY cluster_key) - 1 AS ix,
    count(*) OVER (PARTITION BY brand, cid) AS nu FROM un),
dr AS (SELECT brand, cid, b, ('0x' || substr(md5('777:t:' || brand || ':' || cid || ':' || b || ':' || j),
    1, 15))::BIGINT % nu AS ix FROM (SELECT brand, cid, b, nu, unnest(range(nu)) AS j
    FROM (SELECT DISTINCT brand, cid, nu FROM ui), range(200) t(b))),
nt AS (SELECT brand, cid, b, (sum(pos) - sum(neg)) / nullif(sum(pos) + sum(neg), 0) AS net
  FROM dr JOIN ui USING (brand, cid, ix) GROUP BY ALL)
SELECT brand, cid, round(quantile_cont(net, 0.025), 9) AS ci_lo,
  round(quantile_cont(net, 0.975), 9) AS ci_hi FROM nt GROUP BY ALL""",
)
def topic_intervals(spark, sf_dir):
    got = T.topic_intervals(T.unit_counts(members(spark, sf_dir)), b=200, method="counter")
    return got.select("brand", "cid", *[F.round(c, 9).alias(c) for c in ("ci_lo", "ci_hi")])


@query(
    "j05_assigned_topics",
    GRP + """SELECT mention_id, CASE WHEN vec_id % 7 <> 0 THEN cid END AS topic_id FROM mem""",
)
def assigned_topics(spark, sf_dir):
    m = members(spark, sf_dir)
    known = m.filter(F.col("mention_id").cast("long") % 7 != 0).select(
        "brand", "mention_id", F.col("cid").alias("topic_id")
    )
    return T.assign_topics(m, known).select("mention_id", "topic_id")


@query(
    "u05_brands_without_topics",
    VEC + "SELECT DISTINCT 'topics' AS scope, brand, 'below_minimum' AS reason FROM vec WHERE brand"
    " NOT IN (SELECT brand FROM vec WHERE label = 'positive' AND vec_id % 2 = 0)",
)
def brands_without_topics(spark, sf_dir):
    m = V.vec_mentions(spark, sf_dir)
    some = m.filter((F.col("label") == "positive") & (F.col("mention_id").cast("long") % 2 == 0))
    return T.missing_topics(m.select("brand").distinct(), some)


@query(
    "v04_cosine_top_k",
    VEC + """SELECT mention_id, round(list_dot_product(u, (SELECT u FROM vec WHERE vec_id = 0)), 9) AS score
FROM vec ORDER BY list_dot_product(u, (SELECT u FROM vec WHERE vec_id = 0)) DESC, mention_id LIMIT 20""",
)
def cosine_top_k(spark, sf_dir):
    u = unit(spark, sf_dir)
    question = u.orderBy("mention_id").select("unit").first()["unit"]
    return X.cosine_top_k(u, question).select("mention_id", F.round("score", 9).alias("score"))


@query(
    "v04_cosine_top_k_many",
    VEC + """SELECT question_id, mention_id, round(s, 9) AS score, rank FROM (
  SELECT q.brand || q.mention_id AS question_id, m.mention_id, list_dot_product(m.u, q.u) AS s,
    row_number() OVER (PARTITION BY q.mention_id ORDER BY list_dot_product(m.u, q.u) DESC, m.mention_id)
      AS rank FROM vec m, (SELECT * FROM vec WHERE label = 'irrelevant') q) WHERE rank <= 20""",
)
def cosine_top_k_many(spark, sf_dir):
    u = unit(spark, sf_dir)
    asked = u.filter("label = 'irrelevant'").select(
        F.concat("brand", "mention_id").alias("question_id"), "unit"
    )
    got = X.cosine_top_k_many(u, asked)
    return got.withColumn("score", F.round("score", 9))


@query(
    "j04_embedding_misses",
    """SELECT DISTINCT substr(sha256('m1' || chr(10) || text), 1, 24) AS key FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1')""",
)
def embedding_misses(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    cache = d.filter("source = 'src1'").select(S.embedding_key("m1", "text").alias("key"))
    return X.embedding_misses(d, cache, "m1").select("key")
