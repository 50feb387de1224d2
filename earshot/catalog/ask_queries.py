"""Retrieval and answer-check queries."""

from pyspark.sql import functions as F

from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.functions import scalars as S
from earshot.operators import ask as A
from earshot.operators import retrieval as R
from earshot.operators import vectors as X

QUESTION = "the that with and queque mentre über"
_WORDS = "['the', 'that', 'with', 'and', 'queque', 'mentre', 'über']"


def _docs(spark, sf_dir):
    d = V.doc_mentions(spark, sf_dir)
    return d.withColumn("engagement_score", F.col("doc_id") % 100)


_LEX = V.with_("docm") + f"""SELECT mention_id, overlap FROM (SELECT mention_id, doc_id % 100 AS e,
  len(list_filter({_WORDS}, lambda w: list_contains(toks, w))) AS overlap
  FROM (SELECT *, string_split(norm, ' ') AS toks FROM docm))
ORDER BY overlap DESC, e DESC, mention_id LIMIT 20"""


@query("v05_lexical_top_k", _LEX)
def lexical_top_k(spark, sf_dir):
    got = A.lexical_top_k(_docs(spark, sf_dir), QUESTION, text="norm", normalized=True)
    return got.select("mention_id", "overlap")


@query("v06_retrieve_fallback", _LEX.replace("overlap FROM (SELECT mention_id,", "overlap, 'lexical' AS method FROM (SELECT mention_id,"))
def retrieve_fallback(spark, sf_dir):
    got, method = A.retrieve(_docs(spark, sf_dir).drop("norm"), QUESTION)
    return got.select("mention_id", "overlap", F.lit(method).alias("method"))


@query(
    "v06_retrieve_cosine",
    V.with_("vec") + """SELECT mention_id, 'cosine' AS method FROM vec ORDER BY
  list_dot_product(u, (SELECT u FROM vec WHERE vec_id = 0)) DESC, mention_id LIMIT 20""",
)
def retrieve_cosine(spark, sf_dir):
    u = X.with_unit_vectors(V.vec_mentions(spark, sf_dir))
    question = u.orderBy("mention_id").select("unit").first()["unit"]
    got, method = A.retrieve(u, "", question)
    return got.select("mention_id", F.lit(method).alias("method"))


# Every benchmark item is a question over all documents.
_ASKED = V.with_("docm") + f""", q AS (SELECT item_id, item_id::VARCHAR AS question_id,
    list_distinct(list_filter(string_split({V.norm_sql("text")}, ' '), lambda w: len(w) >= 3)) AS toks FROM benchmark),
m AS (SELECT *, doc_id % 100 AS e, list_distinct(string_split(norm, ' ')) AS toks FROM docm),
hit AS (SELECT question_id, mention_id, count(*) AS n FROM (SELECT question_id, unnest(toks) AS t FROM q)
  JOIN (SELECT mention_id, unnest(toks) AS t FROM m) USING (t) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT q.question_id, q.item_id, m.mention_id, coalesce(n, 0) AS overlap,
    row_number() OVER (PARTITION BY q.question_id ORDER BY coalesce(n, 0) DESC, e DESC, m.mention_id) AS rank
  FROM q CROSS JOIN m LEFT JOIN hit USING (question_id, mention_id)) WHERE rank <= 20)"""


def questions(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


@query("v05_lexical_top_k_many", _ASKED + " SELECT question_id, mention_id, overlap, rank FROM lex")
def lexical_top_k_many(spark, sf_dir):
    got = R.lexical_top_k_many(_docs(spark, sf_dir), questions(spark, sf_dir), text="norm", normalized=True)
    return got.withColumns({"overlap": F.col("overlap").cast("long"), "rank": F.col("rank").cast("long")})


@query(
    "v06_retrieve_many",
    V.with_("vec") + """, cs AS (SELECT * FROM (SELECT q.item_id::VARCHAR AS question_id, m.mention_id,
    row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(m.u, v.u), 12) DESC, m.mention_id) AS rank
  FROM benchmark q JOIN vec v ON v.vec_id = q.item_id CROSS JOIN vec m WHERE q.item_id % 2 = 0) WHERE rank <= 20),
w AS (SELECT mention_id, unnest(list_distinct(list_filter([label, brand, 'vector'], lambda x: len(x) >= 3))) AS t,
    vec_id % 100 AS e FROM vec),
lx AS (SELECT * FROM (SELECT q.item_id::VARCHAR AS question_id, mention_id, row_number() OVER (PARTITION BY q.item_id
    ORDER BY count(*) FILTER (t IN ('vector', 'brand' || (q.item_id % 4), 'positive')) DESC, e DESC, mention_id) AS rank
  FROM benchmark q CROSS JOIN w WHERE q.item_id % 2 = 1 GROUP BY q.item_id, mention_id, e) WHERE rank <= 20)
SELECT question_id, mention_id, rank, 'cosine' AS method FROM cs
UNION ALL SELECT question_id, mention_id, rank, 'lexical' FROM lx""",
)
def retrieve_many(spark, sf_dir):
    u = X.with_unit_vectors(V.vec_mentions(spark, sf_dir))
    number = F.col("mention_id").cast("long")
    m = u.select("mention_id", "unit", F.concat_ws(" ", "label", "brand", F.lit("vector")).alias("text"), (number % 100).alias("engagement_score"))
    asked = questions(spark, sf_dir).withColumn("question", F.concat(F.lit("Vector BRAND"), (F.col("item_id") % 4).cast("string"), F.lit(" positive")))
    own = u.select(number.alias("item_id"), "unit").filter("item_id % 2 = 0")
    # Odd questions have no vector.
    got = R.retrieve_many(m, asked.join(own, "item_id", "left"))
    return got.select("question_id", "mention_id", F.col("rank").cast("long").alias("rank"), "method")


@query(
    "v07_brand_rows",
    V.with_("ev", "rows") + "SELECT mention_id, source FROM rel WHERE brand = 'click'",
)
def brand_rows(spark, sf_dir):
    e = V.ev_labelled(spark, sf_dir).withColumn("raw_ref", F.col("event_id").cast("string"))
    twice = e.unionByName(e.withColumn("raw_ref", F.concat(F.lit("9"), "raw_ref")))
    return A.brand_rows(twice, " CLICK ").select("mention_id", "source")


# -- answers over orders: each states its customer's figures, some of them wrong ------------------
def answers(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    cents = F.round(price * 100).cast("long")
    whole = F.floor(cents / 100)
    figure = F.concat(
        F.format_string("%d.%02d", whole, cents % 100)
    )
    wrong = F.when(k % 10 == 0, "0.5 ").otherwise("")
    cited = lambda i: F.concat(F.lit("k"), i.cast("string"))
    return V.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("answer_id"),
        F.col("o_custkey").alias("customer"),
        F.concat(
            F.lit("spent $"), figure, F.lit(" "), wrong, F.lit("in all [k"), k.cast("string"),
            F.lit("] of 12% on 1998-01-02"),
        ).alias("answer"),
        F.array(cited(k), cited(k), F.lit(" "), cited(-k)).alias("citations"),
    )


def known(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("mention_id"))


def available(spark, sf_dir):
    """Numbers each customer's answers may use: its order totals, and a rate."""
    o = V.table(spark, sf_dir, "orders")
    totals = o.select(
        F.col("o_custkey").alias("customer"),
        F.round("o_totalprice", 2).cast("decimal(38,18)").alias("value"),
    )
    rates = o.select(
        F.col("o_custkey").alias("customer"), F.lit("0.1234").cast("decimal(38,18)").alias("value")
    )
    return totals.unionByName(rates)


@query(
    "j13_citation_gate",
    """SELECT o_orderkey::VARCHAR AS answer_id, 'k' || o_orderkey AS cited, true AS known FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 'k' || -o_orderkey, false FROM orders WHERE o_orderkey <> 0""",
)
def citation_gate(spark, sf_dir):
    got = A.citation_checks(answers(spark, sf_dir), known(spark, sf_dir))
    return got.select("answer_id", "cited", "known")


_NUMS = """n AS (SELECT o_orderkey::VARCHAR AS answer_id, '12%' AS number, true AS verified FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '$' || (round(o_totalprice * 100)::BIGINT // 100) || '.' ||
  lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0'), true FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '0.5', false FROM orders WHERE o_orderkey % 10 = 0)"""


@query("j14_number_gate", f"WITH {_NUMS} SELECT * FROM n")
def number_gate(spark, sf_dir):
    got = A.number_checks(answers(spark, sf_dir), available(spark, sf_dir), ["customer"])
    return got.select("answer_id", "number", "verified")


# Numbers of 25 places: as known, with one digit more, and rounded to 12 places.
_N25 = "'0.' || lpad(o_orderkey::VARCHAR, 12, '0') || lpad(o_custkey::VARCHAR, 13, '0')"


@query(
    "j14_long_numbers",
    f"""SELECT o_orderkey::VARCHAR AS answer_id, {_N25} AS number, true AS verified FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, {_N25} || '7', false FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, substr({_N25}, 1, 14), true FROM orders""",
)
def long_numbers(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    padded = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    known_number = F.concat(F.lit("0."), padded("o_orderkey", 12), padded("o_custkey", 13))
    told = F.concat(F.lit("exactly "), "n", F.lit(" not "), "n", F.lit("7 or so "), F.left("n", F.lit(14)), F.lit("."))
    texts = o.withColumn("n", known_number).select(
        F.col("o_orderkey").cast("string").alias("answer_id"), F.col("o_custkey").alias("customer"), told.alias("answer")
    )
    have = o.select(F.col("o_custkey").alias("customer"), known_number.alias("value"))
    return A.number_checks(texts, have, ["customer"]).select("answer_id", "number", "verified")


@query(
    "v08_nested_numbers",
    """SELECT status, round(v, 6) AS value FROM (SELECT l_linestatus AS status, l_quantity AS v FROM lineitem
UNION SELECT l_linestatus, l_discount FROM lineitem UNION SELECT l_linestatus, l_linenumber FROM lineitem
UNION SELECT l_linestatus, 12.5 FROM lineitem UNION SELECT l_linestatus, -3 FROM lineitem) GROUP BY ALL""",
)
def nested_numbers(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    note = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of 12.5% on 1998-01-02"))
    part = F.struct(F.col("l_discount").alias("rate"), note.alias("note"), F.lit("https://x.y/99").alias("url"))
    records = li.select(
        F.col("l_linestatus").alias("status"), F.lit("77").alias("run_id"), F.lit(True).alias("billed"),
        F.struct(
            "l_quantity", F.array(part).alias("parts"), F.create_map(F.lit("change"), F.lit(-3)).alias("by_name"),
            F.array(F.lit("m12")).alias("exemplar_mention_ids"),
        ).alias("stats"),
    )
    got = A.available_from_records(records, ["status"])
    return got.select("status", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    "v08_available_numbers",
    """SELECT round(v, 4) AS value FROM (SELECT l_quantity AS v FROM lineitem UNION SELECT l_discount
  FROM lineitem UNION SELECT n_nationkey FROM nation) GROUP BY ALL""",
)
def available_numbers(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    numeric = A.available_from_columns(li, ["l_quantity", "l_discount"])
    names = A.available_from_texts(
        V.table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("NATION_"), F.lit("no ")).alias("t")),
        ["t"],
    )
    both = numeric.unionByName(names).distinct()
    return both.select(F.round(F.col("value").cast("double"), 4).alias("value"))


@query(
    "v09_check_answers",
    """SELECT o_orderkey::VARCHAR AS answer_id, CASE WHEN o_orderkey <> 0 OR o_orderkey % 10 = 0
    THEN 'unverified' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey <> 0 THEN 'k-' || o_orderkey ELSE '' END AS unknown,
  CASE WHEN o_orderkey % 10 = 0 THEN '0.5' ELSE '' END AS foreign_numbers FROM orders""",
)
def check_answers(spark, sf_dir):
    got = A.check_answers(
        answers(spark, sf_dir), known(spark, sf_dir), available(spark, sf_dir), ["customer"]
    )
    return got.select(
        "answer_id", "status", F.array_join("citations_unknown", ",").alias("unknown"),
        F.array_join("foreign_numbers", ",").alias("foreign_numbers"),
    )


@query(
    "v10_narration_check",
    """SELECT event_id::VARCHAR AS answer_id, event_id % 9 <> 0 AS numbers_verified FROM events""",
)
def narration_check(spark, sf_dir):
    e, i = V.table(spark, sf_dir, "events"), F.col("event_id")
    hundredths = F.round(F.col("value") * 100).cast("long")
    told = F.format_string(
        "net fell by minus %d.%02d, share 7 per cent", F.floor(hundredths / 100), hundredths % 100
    )
    texts = e.select(
        i.cast("string").alias("answer_id"), F.col("event_type").alias("brand"),
        F.when(i % 9 == 0, F.concat(told, F.lit(" and 123456789"))).otherwise(told).alias("narration"),
    )
    digest = e.select(
        F.col("event_type").alias("brand"),
        (-F.round("value", 2)).cast("decimal(38,18)").alias("value"),
    ).unionByName(
        e.select(F.col("event_type").alias("brand"), F.lit("0.0712").cast("decimal(38,18)").alias("value"))
    )
    got = A.narration_checks(texts, digest, ["brand"])
    return got.select("answer_id", "numbers_verified")
