"""Share, sentiment, verdict and event queries over the events table."""

from pyspark.sql import functions as F

from earshot import config
from earshot.catalog import views as V
from earshot.catalog.registry import query
from earshot.operators import bootstrap as B
from earshot.operators import events as E
from earshot.operators import frame as R
from earshot.operators import verdicts
from earshot.functions import scalars as S
from earshot.plans.stats import StatsPlan

B_CHECK = 200
EV = V.with_("ev", "rows")
SPIKE = V.with_("ev_spikes", "rows")
THIN = V.with_("ev_thin", "rows")


def plan(spark, sf_dir, shape=None, b=B_CHECK):
    brands = (*V.BRANDS, V.REST) if shape == V.THIN else V.BRANDS
    return StatsPlan(
        V.ev_labelled(spark, sf_dir, shape),
        R.brand_table(spark, brands),
        V.EV_BASIS,
        V.NOW,
        b=b,
        # Draws that the SQL can repeat.
        method="counter",
    )


def r9(column):
    return F.round(column, 9).alias(column) if isinstance(column, str) else F.round(column, 9)


@query(
    "a07_share_of_voice",
    EV + """, per AS (
  SELECT brand, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters,
    count(*) FILTER (period = 'current') AS cur,
    count(DISTINCT cluster_key) FILTER (period = 'current') AS ccur
  FROM rel WHERE in_basis GROUP BY brand)
SELECT brand, n, n_clusters,
  CASE WHEN cur >= 20 AND ccur >= 5 THEN round(n / sum(n) OVER (), 9) END AS share FROM per""",
)
def share_of_voice(spark, sf_dir):
    return plan(spark, sf_dir).share_points().select("brand", "n", "n_clusters", r9("share"))


# -- predicates and counts ------------------------------------------------------------------------
@query("p02_relevant_rows", EV + "SELECT brand, source, count(*) AS n FROM rel GROUP BY ALL")
def relevant_rows(spark, sf_dir):
    rows = R.stats_rows(V.ev_labelled(spark, sf_dir), V.NOW)
    return rows.groupBy("brand", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p03_digest_rows",
    V.with_("ev") + """SELECT brand, count(*) AS n FROM ev
WHERE status IN ('ok', 'cached') AND about_brand AND label <> 'irrelevant' GROUP BY brand""",
)
def digest_rows(spark, sf_dir):
    kept = V.ev_labelled(spark, sf_dir).filter(R.relevant_for_digest())
    return kept.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f15_periods",
    EV + "SELECT coalesce(period, 'none') AS period, count(*) AS n FROM rel GROUP BY ALL",
)
def periods(spark, sf_dir):
    rows = R.stats_rows(V.ev_labelled(spark, sf_dir), V.NOW)
    period = F.coalesce("period", F.lit("none")).alias("period")
    return rows.groupBy(period).agg(F.count(F.lit(1)).alias("n"))


@query("f16_utc_days", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def utc_days(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", S.utc_day("ts").cast("string").alias("day"))


@query(
    "f12_engagement_score",
    "SELECT event_id, floor(value)::BIGINT + event_id % 7 AS score FROM events",
)
def engagement_score(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    counts = F.create_map(
        F.lit("likes"), F.floor("value").cast("long"), F.lit("shares"), F.col("event_id") % 7
    )
    return e.select("event_id", S.engagement_score(counts).alias("score"))


@query(
    "f05_author_hash",
    "SELECT user_id, substr(sha256('reddit' || chr(10) || 'user' || user_id), 1, 16) AS author_hash"
    " FROM events GROUP BY user_id",
)
def author_hash(spark, sf_dir):
    users = V.table(spark, sf_dir, "events").select("user_id").distinct()
    handle = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return users.select("user_id", S.author_hash(F.lit("reddit"), handle).alias("author_hash"))


@query(
    "j07_basis_sources",
    V.with_("ev") + "SELECT DISTINCT source FROM ev WHERE source <> 'tiktok'",
)
def basis_sources(spark, sf_dir):
    sources = V.ev_labelled(spark, sf_dir).select("source")
    return R.basis_sources(sources, V.ev_abstentions(spark, sf_dir))


@query(
    "a06_period_counts",
    EV + """SELECT brand, count(*) FILTER (period = 'current') AS cur_all,
  count(DISTINCT cluster_key) FILTER (period = 'current') AS clusters_cur_all,
  count(*) FILTER (period = 'previous') AS prev_all,
  count(DISTINCT cluster_key) FILTER (period = 'previous') AS clusters_prev_all
FROM rel GROUP BY brand""",
)
def period_counts(spark, sf_dir):
    return plan(spark, sf_dir).counts().select(
        "brand", "cur_all", "clusters_cur_all", "prev_all", "clusters_prev_all"
    )


@query(
    "a05_distinct_clusters",
    EV + """SELECT brand, count(DISTINCT cluster_key) AS clusters_n_all,
  count(DISTINCT cluster_key) FILTER (in_basis) AS clusters_n_basis FROM rel GROUP BY brand""",
)
def distinct_clusters(spark, sf_dir):
    return plan(spark, sf_dir).counts().select("brand", "clusters_n_all", "clusters_n_basis")


_MINIMUMS = THIN + """, per AS (
  SELECT brand, count(*) FILTER (period = 'current') AS cur,
    count(DISTINCT cluster_key) FILTER (period = 'current') AS ccur,
    count(*) FILTER (period = 'previous') AS prev,
    count(DISTINCT cluster_key) FILTER (period = 'previous') AS cprev
  FROM rel GROUP BY brand),
txt AS (SELECT brand,
  concat_ws('; ', CASE WHEN cur < 20 THEN 'n=' || cur || ' < 20 in current' END,
    CASE WHEN ccur < 5 THEN 'n_clusters=' || ccur || ' < 5 in current' END) AS level,
  concat_ws('; ', CASE WHEN cur < 20 THEN 'n=' || cur || ' < 20 in current' END,
    CASE WHEN ccur < 5 THEN 'n_clusters=' || ccur || ' < 5 in current' END,
    CASE WHEN prev < 20 THEN 'n=' || prev || ' < 20 in previous' END,
    CASE WHEN cprev < 5 THEN 'n_clusters=' || cprev || ' < 5 in previous' END) AS wow FROM per)
SELECT brand, CASE WHEN level <> '' THEN 'net: ' || level END AS level_detail,
  CASE WHEN wow <> '' THEN 'net: ' || wow END AS wow_detail FROM txt"""


@query("p06_minimums", _MINIMUMS)
def minimums(spark, sf_dir):
    points = plan(spark, sf_dir, V.THIN).net_points()
    return points.select("brand", "level_detail", "wow_detail")


_POLAR = """count(*) FILTER (polarity = 'positive') AS pos,
  count(*) FILTER (polarity = 'negative') AS neg, count(*) FILTER (polarity = 'neutral') AS neu"""


@query(
    "a03_polarity_counts",
    EV + f"""SELECT brand, count(*) AS n, count(*) FILTER (confirmed) AS n_confirmed, {_POLAR}
FROM rel GROUP BY brand""",
)
def polarity_counts(spark, sf_dir):
    return plan(spark, sf_dir).net_points().select("brand", "n", "n_confirmed", "pos", "neg", "neu")


@query(
    "a04_by_source_counts",
    EV + f""", grid AS (SELECT brand, source FROM (SELECT DISTINCT brand FROM ev),
  (SELECT DISTINCT source FROM ev WHERE source <> 'tiktok')),
g AS (SELECT brand, source, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters, {_POLAR}
  FROM rel GROUP BY ALL)
SELECT brand, source, coalesce(n, 0) AS n, coalesce(n_clusters, 0) AS n_clusters,
  coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(neu, 0) AS neu
FROM grid LEFT JOIN g USING (brand, source)""",
)
def by_source_counts(spark, sf_dir):
    return plan(spark, sf_dir).source_points().select(
        "brand", "source", "n", "n_clusters", "pos", "neg", "neu"
    )


_NET = "round((pos - neg) / nullif(pos + neg + neu, 0), 9)"


@query(
    "a08_net_points",
    EV + f""", g AS (SELECT brand, {_POLAR} FROM rel GROUP BY brand)
SELECT brand, {_NET} AS net FROM g""",
)
def net_points(spark, sf_dir):
    return plan(spark, sf_dir).net_points().select("brand", r9(F.col("net_all")).alias("net"))


def _net_of(where):
    pos, neg, neu = (f"count(*) FILTER (polarity = '{p}' AND {where})" for p in config.POLARITIES)
    return f"({pos} - {neg}) / nullif({pos} + {neg} + {neu}, 0)"


@query(
    "a09_week_over_week",
    EV + f""", g AS (SELECT brand,
    {_net_of("period = 'current'")} - {_net_of("period = 'previous'")} AS net_delta,
    count(*) FILTER (in_basis AND period = 'current') AS cur,
    count(*) FILTER (in_basis AND period = 'previous') AS prev
  FROM rel GROUP BY brand)
SELECT brand, round(net_delta, 9) AS net_delta,
  round(cur / sum(cur) OVER () - prev / sum(prev) OVER (), 9) AS share_delta FROM g""",
)
def week_over_week(spark, sf_dir):
    p = plan(spark, sf_dir)
    return p.net_points().join(p.share_points().select("brand", "delta"), "brand").select(
        "brand", r9(F.col("delta_all")).alias("net_delta"), r9(F.col("delta")).alias("share_delta")
    )


@query(
    "a10_wow_scope",
    V.with_("ev") + "SELECT brand, source, bool_or(published_at IS NOT NULL) AS wow_scope"
    " FROM ev GROUP BY ALL",
)
def wow_scope(spark, sf_dir):
    return R.wow_scope(V.ev_labelled(spark, sf_dir))


@query(
    "a23_unit_totals",
    EV + f"""SELECT brand, cluster_key, count(*) AS n, {_POLAR} FROM rel GROUP BY ALL""",
)
def unit_totals(spark, sf_dir):
    cells = R.unit_cells(R.stats_rows(V.ev_labelled(spark, sf_dir), V.NOW))
    return cells.groupBy("brand", "cluster_key").agg(
        F.sum("n").alias("n"), *R.polarity_sums(F.col("n"))
    )


@query(
    "w13_unit_index",
    EV + """, u AS (SELECT DISTINCT brand, cluster_key FROM rel)
SELECT brand, cluster_key, row_number() OVER (ORDER BY brand, cluster_key) - 1 AS unit FROM u""",
)
def unit_index(spark, sf_dir):
    rows = R.stats_rows(V.ev_labelled(spark, sf_dir), V.NOW)
    ordered = rows.join(R.brand_table(spark, V.BRANDS), "brand")
    return R.unit_index(ordered).select("brand", "cluster_key", "unit")


@query(
    "f26_event_threshold",
    "SELECT event_id, round(greatest(5.0, value + 3.0 * (event_id % 4)), 9) AS threshold FROM events",
)
def event_threshold(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("mad", F.col("event_id") % 4)
    return e.select("event_id", r9(S.event_threshold("value", "mad")).alias("threshold"))


@query(
    "f27_net_and_share",
    "SELECT event_type, round((count(*) FILTER (value > 60) - count(*) FILTER (value < 20)) /"
    " nullif(count(*), 0), 9) AS net, round(count(*) FILTER (value > 60) / nullif(count(*)"
    " FILTER (value > 1e9), 0), 9) AS nothing FROM events GROUP BY event_type",
)
def net_and_share(spark, sf_dir):
    v = F.col("value")
    g = V.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(v > 60).alias("pos"),
        F.count_if(v < 20).alias("neg"),
        F.count_if((v >= 20) & (v <= 60)).alias("neu"),
        F.count_if(v > 1e9).alias("none"),
    )
    return g.select(
        "event_type", r9(S.net("pos", "neg", "neu")).alias("net"),
        r9(S.ratio("pos", "none")).alias("nothing"),
    )


# -- resampling -----------------------------------------------------------------------------------
_UNITS = """, ucells AS (
  SELECT brand, cluster_key, source, period, polarity, confirmed,
    concat_ws('|', source, coalesce(period, '-'), coalesce(polarity, '-'),
      CASE WHEN confirmed THEN '1' ELSE '0' END) AS cell, count(*) AS n
  FROM rel GROUP BY ALL),
uidx AS (SELECT brand, cluster_key, row_number() OVER (ORDER BY kind, brand, cluster_key) - 1 AS idx
  FROM (SELECT brand, cluster_key,
    md5(brand || chr(10) || string_agg(cell || '=' || n, ',' ORDER BY cell)) AS kind
    FROM ucells GROUP BY brand, cluster_key)),
cdraw AS (SELECT b, idx, count(*) AS w FROM (
    SELECT b, ('0x' || substr(md5('777:c:' || b || ':' || j), 1, 15))::BIGINT % n AS idx
    FROM (SELECT b, n, unnest(range(n)) AS j
      FROM (SELECT count(*) AS n FROM uidx), range(200) t(b))) GROUP BY ALL),
cd AS (SELECT b, brand, source, period, polarity, confirmed, sum(w * n)::BIGINT AS w
  FROM cdraw JOIN uidx USING (idx) JOIN ucells USING (brand, cluster_key) GROUP BY ALL)"""
_ROWS = """, ridx AS (SELECT brand, source, period, polarity, confirmed,
    row_number() OVER (ORDER BY md5(brand || chr(10) || concat_ws('|', source,
      coalesce(period, '-'), coalesce(polarity, '-'), CASE WHEN confirmed THEN '1' ELSE '0' END)
      || '=1')) - 1 AS idx FROM rel),
idraw AS (SELECT b, ('0x' || substr(md5('777:i:' || b || ':' || j), 1, 15))::BIGINT % n AS idx
    FROM (SELECT b, n, unnest(range(n)) AS j
      FROM (SELECT count(*) AS n FROM ridx), range(200) t(b))),
idr AS (SELECT b, brand, source, period, polarity, confirmed, count(*) AS w
  FROM idraw JOIN ridx USING (idx) GROUP BY ALL)"""


@query(
    "b01_cluster_bootstrap",
    EV + _UNITS + """SELECT b, brand, source, coalesce(period, '-') AS period,
  coalesce(polarity, '-') AS polarity, confirmed, w FROM cd""",
)
def cluster_bootstrap(spark, sf_dir):
    d = plan(spark, sf_dir).cluster_draws()
    return d.fillna("-", subset=["period", "polarity"])


@query(
    "b02_iid_bootstrap",
    EV + _ROWS + """SELECT b, brand, coalesce(polarity, '-') AS polarity, sum(w)::BIGINT AS w
FROM idr GROUP BY ALL""",
)
def iid_bootstrap(spark, sf_dir):
    d = plan(spark, sf_dir).iid_draws().fillna("-", subset=["polarity"])
    return d.groupBy("b", "brand", "polarity").agg(F.sum("w").alias("w"))


@query("b01_multinomial_bootstrap")
def multinomial_bootstrap(spark, sf_dir):
    """Live number of resamples, drawn over kinds of units."""
    p = plan(spark, sf_dir, b=config.B_LIVE)
    p.method = "multinomial"
    return p.net_intervals().join(p.share_intervals().select("brand", "ci_lo", "ci_hi").toDF(
        "brand", "share_lo", "share_hi"), "brand")


_SHARE_DRAWS = """, sd AS (SELECT b, brand, coalesce(f, 0) AS f, coalesce(c, 0) AS c, coalesce(p, 0) AS p
  FROM (SELECT b, brand FROM range(200) t(b), (SELECT DISTINCT brand FROM ev))
  LEFT JOIN (SELECT b, brand, sum(w) AS f, sum(w) FILTER (period = 'current') AS c,
      sum(w) FILTER (period = 'previous') AS p
    FROM cd WHERE source <> 'tiktok' GROUP BY ALL) USING (b, brand)),
shd AS (SELECT b, brand, f / nullif(sum(f) OVER (PARTITION BY b), 0) AS share,
    c / nullif(sum(c) OVER (PARTITION BY b), 0) - p / nullif(sum(p) OVER (PARTITION BY b), 0) AS delta
  FROM sd)"""
_NETS = """sum(w) FILTER (polarity = 'positive' AND {0}) AS {1}pos,
  sum(w) FILTER (polarity = 'negative' AND {0}) AS {1}neg,
  sum(w) FILTER (polarity = 'neutral' AND {0}) AS {1}neu"""
_N = (
    "((coalesce({0}pos, 0) - coalesce({0}neg, 0)) /"
    " nullif(coalesce({0}pos, 0) + coalesce({0}neg, 0) + coalesce({0}neu, 0), 0))"
)


def _net_draws(source, name):
    return f""", {name}0 AS (SELECT b, brand, {_NETS.format('true', 'a')},
  {_NETS.format("period = 'current'", 'c')}, {_NETS.format("period = 'previous'", 'p')},
  {_NETS.format("period = 'current' AND confirmed", 'cc')},
  {_NETS.format("period = 'previous' AND confirmed", 'pc')} FROM {source} GROUP BY ALL),
{name} AS (SELECT b, brand, {_N.format('a')} AS net, {_N.format('c')} - {_N.format('p')} AS delta,
  {_N.format('cc')} - {_N.format('pc')} AS cdelta FROM {name}0)"""


def _q(column, tail):
    return f"quantile_cont({column}, {tail})"


def _p(column):
    return (
        f"least(1.0, 2.0 * least(count(*) FILTER ({column} <= 0) / count({column}),"
        f" count(*) FILTER ({column} >= 0) / count({column})))"
    )


@query(
    "b03_share_intervals",
    EV + _UNITS + _SHARE_DRAWS + f"""SELECT brand, round({_q('share', 0.025)}, 9) AS ci_lo,
  round({_q('share', 0.975)}, 9) AS ci_hi, round({_q('delta', 0.025)}, 9) AS lo,
  round({_q('delta', 0.975)}, 9) AS hi, round({_p('delta')}, 9) AS p_raw FROM shd GROUP BY brand""",
)
def share_intervals(spark, sf_dir):
    got = plan(spark, sf_dir).share_intervals()
    return got.select("brand", *[r9(c) for c in ("ci_lo", "ci_hi", "lo", "hi", "p_raw")])


_NET_CI = EV + _UNITS + _ROWS + _net_draws("cd", "nd") + _net_draws("idr", "ni") + f""",
ci AS (SELECT brand, {_q('net', 0.025)} AS ci_lo, {_q('net', 0.975)} AS ci_hi,
  {_q('delta', 0.025)} AS lo, {_q('delta', 0.975)} AS hi, {_q('cdelta', 0.025)} AS conf_lo,
  {_q('cdelta', 0.975)} AS conf_hi, {_p('delta')} AS p_raw FROM nd GROUP BY brand),
ici AS (SELECT brand, {_q('net', 0.025)} AS iid_lo, {_q('net', 0.975)} AS iid_hi
  FROM ni GROUP BY brand)"""


@query(
    "b04_net_intervals",
    _NET_CI + """SELECT brand, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi,
  round(iid_lo, 9) AS iid_lo, round(iid_hi, 9) AS iid_hi,
  round(pow((ci_hi - ci_lo) / nullif(iid_hi - iid_lo, 0), 2), 9) AS design_effect
FROM ci JOIN ici USING (brand)""",
)
def net_intervals(spark, sf_dir):
    got = plan(spark, sf_dir).net_intervals()
    return got.select(
        "brand", *[r9(c) for c in ("ci_lo", "ci_hi", "iid_lo", "iid_hi", "design_effect")]
    )


@query(
    "b05_net_delta_intervals",
    _NET_CI + """SELECT brand, round(lo, 9) AS lo, round(hi, 9) AS hi, round(conf_lo, 9) AS conf_lo,
  round(conf_hi, 9) AS conf_hi, round(p_raw, 9) AS p_raw FROM ci""",
)
def net_delta_intervals(spark, sf_dir):
    got = plan(spark, sf_dir).net_changes()
    return got.select("brand", *[r9(c) for c in ("lo", "hi", "conf_lo", "conf_hi", "p_raw")])


_FAMILY = _NET_CI + _SHARE_DRAWS + f""", sci AS (SELECT brand, {_q('delta', 0.025)} AS lo,
  {_q('delta', 0.975)} AS hi, {_p('delta')} AS p_raw FROM shd GROUP BY brand),
pt AS (SELECT brand, {_net_of("period = 'current'")} - {_net_of("period = 'previous'")} AS nd,
    count(*) FILTER (in_basis AND period = 'current') AS c,
    count(*) FILTER (in_basis AND period = 'previous') AS p FROM rel GROUP BY brand),
ptt AS (SELECT brand, nd, c / sum(c) OVER () - p / sum(p) OVER () AS sd FROM pt),
fam AS (SELECT brand, 'net' AS estimand, 0 AS f, nd AS delta, lo, hi, conf_lo, conf_hi, p_raw
    FROM ci JOIN ptt USING (brand)
  UNION ALL SELECT brand, 'share', 1, sd, lo, hi, NULL, NULL, p_raw FROM sci JOIN ptt USING (brand)),
stp AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, f, brand) + 1)
    * p_raw) AS s, row_number() OVER (ORDER BY p_raw, f, brand) AS rk FROM fam),
hol AS (SELECT *, max(s) OVER (ORDER BY rk) AS p_holm,
  CASE WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END AS sf,
  CASE WHEN conf_lo > 0 THEN 1 WHEN conf_hi < 0 THEN -1 ELSE 0 END AS sc FROM stp),
dec AS (SELECT *, CASE WHEN sf * sc = -1 THEN 'ABSTAIN'
    WHEN p_holm < 0.05 AND (estimand = 'share' OR (conf_lo IS NOT NULL AND delta <> 0
      AND sc = sign(delta))) THEN 'SIGNIFICANT'
    WHEN p_raw < 0.05 THEN 'SUGGESTIVE' ELSE 'NO_CHANGE_DETECTED' END AS verdict FROM hol)"""


@query(
    "b06_family_verdicts",
    _FAMILY + """SELECT brand, estimand, round(delta, 9) AS delta, round(p_raw, 9) AS p_raw,
  round(p_holm, 9) AS p_holm, verdict FROM dec""",
)
def family_verdicts(spark, sf_dir):
    got = plan(spark, sf_dir).tests()
    return got.select("brand", "estimand", *[r9(c) for c in ("delta", "p_raw", "p_holm")], "verdict")


@query(
    "b06_family_abstentions",
    _MINIMUMS.replace("SELECT brand, CASE WHEN level", """, bper AS (
  SELECT brand, count(*) FILTER (period = 'current') AS cur,
    count(DISTINCT cluster_key) FILTER (period = 'current') AS ccur,
    count(*) FILTER (period = 'previous') AS prev,
    count(DISTINCT cluster_key) FILTER (period = 'previous') AS cprev
  FROM rel WHERE in_basis GROUP BY brand),
share AS (SELECT brand, concat_ws('; ', CASE WHEN cur < 20 THEN 'n=' || cur || ' < 20 in current' END,
    CASE WHEN ccur < 5 THEN 'n_clusters=' || ccur || ' < 5 in current' END,
    CASE WHEN prev < 20 THEN 'n=' || prev || ' < 20 in previous' END,
    CASE WHEN cprev < 5 THEN 'n_clusters=' || cprev || ' < 5 in previous' END) AS wow FROM bper)
SELECT brand, 'below_minimum' AS reason, 'net: ' || wow AS detail FROM txt WHERE wow <> ''
UNION ALL SELECT brand, 'below_minimum', 'share: ' || wow FROM share WHERE wow <> ''
-- SELECT brand, CASE WHEN level""").split("-- SELECT")[0],
)
def family_abstentions(spark, sf_dir):
    rows = verdicts.family_abstentions(plan(spark, sf_dir, V.THIN).tests())
    return rows.filter("reason = 'below_minimum'").select("brand", "reason", "detail")


@query(
    "b08_sentiment",
    _FAMILY + f""", g AS (SELECT brand, count(*) AS n, count(*) FILTER (confirmed) AS n_confirmed,
  {_POLAR} FROM rel GROUP BY brand)
SELECT g.brand, n, n_confirmed, pos, neg, neu, {_NET} AS net, round(ci.ci_lo, 9) AS ci_lo,
  round(ci.ci_hi, 9) AS ci_hi,
  round(pow((ci_hi - ci_lo) / nullif(iid_hi - iid_lo, 0), 2), 9) AS design_effect, verdict
FROM g JOIN ci USING (brand) JOIN ici USING (brand) JOIN dec ON dec.brand = g.brand
  AND estimand = 'net'""",
)
def sentiment(spark, sf_dir):
    got = plan(spark, sf_dir).sentiment()
    return got.select(
        "brand", "n", "n_confirmed", "pos", "neg", "neu",
        *[r9(c) for c in ("net", "ci_lo", "ci_hi", "design_effect")],
        F.col("wow.verdict").alias("verdict"),
    )


@query(
    "b08_share_of_voice",
    _FAMILY + f""", g AS (SELECT brand, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters
  FROM rel WHERE in_basis GROUP BY brand),
si AS (SELECT brand, {_q('share', 0.025)} AS ci_lo, {_q('share', 0.975)} AS ci_hi FROM shd GROUP BY brand)
SELECT g.brand, n, n_clusters, round(n / sum(n) OVER (), 9) AS share, round(si.ci_lo, 9) AS ci_lo,
  round(si.ci_hi, 9) AS ci_hi, 'reddit,google_maps,news' AS basis, verdict
FROM g JOIN si USING (brand) JOIN dec ON dec.brand = g.brand AND estimand = 'share'""",
)
def share_of_voice_full(spark, sf_dir):
    got = plan(spark, sf_dir).share_of_voice()
    return got.select(
        "brand", "n", "n_clusters", *[r9(c) for c in ("share", "ci_lo", "ci_hi")],
        F.array_join("basis_sources", ",").alias("basis"), F.col("wow.verdict").alias("verdict"),
    )


def _source_draws(source, name):
    return f""", {name} AS (SELECT brand, source, {_q('net', 0.025)} AS {name}_lo,
  {_q('net', 0.975)} AS {name}_hi FROM (SELECT b, brand, source, {_N.format('a')} AS net FROM
    (SELECT b, brand, source, {_NETS.format('true', 'a')} FROM {source} GROUP BY ALL)) GROUP BY ALL)"""


_BY_SOURCE = EV + _UNITS + _ROWS + _source_draws("cd", "sc") + _source_draws("idr", "sr") + f""",
bs AS (SELECT r.brand, r.source, n, n_clusters, pos, neg, neu, {_NET} AS net, sc_lo, sc_hi, sr_lo,
  sr_hi, pow((sc_hi - sc_lo) / nullif(sr_hi - sr_lo, 0), 2) AS de
  FROM (SELECT brand, source, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters, {_POLAR}
    FROM rel WHERE in_basis GROUP BY ALL) r JOIN sc USING (brand, source)
  JOIN sr USING (brand, source))"""


@query(
    "b08_by_source",
    _BY_SOURCE + """SELECT brand, source, n, n_clusters, pos, neg, neu, net, round(sc_lo, 9) AS ci_lo,
  round(sc_hi, 9) AS ci_hi, round(sr_lo, 9) AS iid_lo, round(sr_hi, 9) AS iid_hi,
  round(de, 9) AS design_effect, true AS wow_scope FROM bs""",
)
def by_source(spark, sf_dir):
    got = plan(spark, sf_dir).by_source()
    return got.select(
        "brand", "source", "n", "n_clusters", "pos", "neg", "neu",
        *[r9(c) for c in ("net", "ci_lo", "ci_hi", "iid_lo", "iid_hi", "design_effect")],
        "wow_scope",
    )


@query(
    "a25_h2_entries",
    _BY_SOURCE + """SELECT brand, source, n, n_clusters, round(de, 9) AS design_effect, de >= 1.5 AS passed
FROM bs WHERE source IN ('reddit', 'youtube_comment') AND n >= 20 AND n_clusters >= 5""",
)
def h2_entries(spark, sf_dir):
    from earshot.operators.counts import h2_entries as entries

    got = entries(plan(spark, sf_dir).by_source())
    return got.select("brand", "source", "n", "n_clusters", r9("design_effect"), "passed")


@query(
    "a20_percentile_interval",
    "SELECT event_type, round(quantile_cont(value, 0.025), 9) AS lo,"
    " round(quantile_cont(value, 0.975), 9) AS hi FROM events GROUP BY event_type",
)
def percentile_interval(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy("event_type").agg(
        B.percentile_interval("value").alias("ci")
    )
    return e.select("event_type", r9(F.col("ci")[0]).alias("lo"), r9(F.col("ci")[1]).alias("hi"))


@query(
    "a21_two_sided_p",
    "SELECT event_type, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 9)"
    " AS p FROM (SELECT event_type, value - 8.0 AS d FROM events) GROUP BY event_type",
)
def two_sided_p(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("d", F.col("value") - 8.0)
    return e.groupBy("event_type").agg(r9(B.two_sided_p("d")).alias("p"))


@query(
    "f35_design_effect",
    "SELECT user_id, round(pow((max(value) - min(value)) / nullif(max(event_id % 3) - min(event_id"
    " % 3), 0), 2), 6) AS design_effect FROM events GROUP BY user_id",
)
def design_effect(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("m", F.col("event_id") % 3)
    g = e.groupBy("user_id").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min("m").alias("a"), F.max("m").alias("z"),
    )
    return g.select(
        "user_id", F.round(S.design_effect("lo", "hi", "a", "z"), 6).alias("design_effect")
    )


_TESTS = """t AS (SELECT event_id, event_type, CASE WHEN event_id % 10 <> 0 THEN
  ((event_id * 37) % 1000) / 20000.0::DOUBLE END AS p_raw FROM events)"""


@query(
    "w09_holm",
    f"""WITH {_TESTS}, s AS (SELECT *, row_number() OVER w AS rk,
  least(1.0, (count(p_raw) OVER (PARTITION BY grp) - row_number() OVER w + 1) * p_raw) AS st
  FROM (SELECT *, event_id // 10 AS grp FROM t)
  WINDOW w AS (PARTITION BY grp ORDER BY p_raw NULLS LAST, event_id))
SELECT event_id, CASE WHEN p_raw IS NOT NULL THEN round(max(st) OVER (PARTITION BY grp ORDER BY rk), 9)
  END AS p_holm FROM s""",
)
def holm(spark, sf_dir):
    i = F.col("event_id")
    tests = V.table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(i / 10).alias("family"),
        F.when(i % 10 != 0, (i * 37) % 1000 / 20000.0).alias("p_raw"),
    )
    got = verdicts.holm(tests, ["family"], position="event_id")
    return got.select("event_id", r9("p_holm"))


@query(
    "f28_wow_verdict",
    """WITH t AS (SELECT event_id, value / 50 - 1 AS lo, value / 50 - 0.8 AS hi,
    CASE WHEN event_id % 7 <> 0 THEN 1 - value / 50 END AS cl,
    CASE WHEN event_id % 7 <> 0 THEN 1.2 - value / 50 END AS ch,
    (event_id % 100) / 1000.0::DOUBLE AS p, event_id % 2 = 0 AS share FROM events),
s AS (SELECT *, CASE WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END AS a,
    CASE WHEN cl > 0 THEN 1 WHEN ch < 0 THEN -1 ELSE 0 END AS c FROM t)
SELECT CASE WHEN a * c = -1 THEN 'ABSTAIN'
    WHEN p * 2 < 0.05 AND (share OR (cl IS NOT NULL AND hi <> 0 AND c = sign(hi))) THEN 'SIGNIFICANT'
    WHEN p < 0.05 THEN 'SUGGESTIVE' ELSE 'NO_CHANGE_DETECTED' END AS verdict, count(*) AS n
FROM s GROUP BY ALL""",
)
def wow_verdict(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    t = V.table(spark, sf_dir, "events").select(
        (v / 50 - 1).alias("lo"), (v / 50 - 0.8).alias("hi"),
        F.when(i % 7 != 0, 1 - v / 50).alias("cl"), F.when(i % 7 != 0, 1.2 - v / 50).alias("ch"),
        (i % 100 / 1000.0).alias("p"), (i % 2 == 0).alias("share"),
    )
    word = S.wow_verdict("hi", "lo", "hi", "cl", "ch", "p", F.col("p") * 2, "share")
    return t.groupBy(word.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# -- events ---------------------------------------------------------------------------------------
_DAYS = SPIKE + """, cal AS (SELECT brand, d::DATE AS day FROM (SELECT DISTINCT brand FROM
    (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(brand)),
    (SELECT unnest(generate_series(TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d)),
cnt AS (SELECT brand, day, count(*) AS n, count(DISTINCT cluster_key) AS n_clusters
  FROM rel WHERE day IS NOT NULL GROUP BY ALL),
days AS (SELECT brand, day, coalesce(n, 0) AS n, coalesce(n_clusters, 0) AS n_clusters
  FROM cal LEFT JOIN cnt USING (brand, day))"""
_BASE = _DAYS + """, med AS (SELECT a.brand, a.day, a.n, a.n_clusters, median(o.n) AS m
  FROM days a JOIN days o ON a.brand = o.brand AND a.day <> o.day GROUP BY ALL),
bas AS (SELECT a.brand, a.day, a.n, a.n_clusters, m AS baseline_median,
    median(abs(o.n - m)) AS baseline_mad
  FROM med a JOIN days o ON a.brand = o.brand AND a.day <> o.day GROUP BY ALL),
spk AS (SELECT *, greatest(5.0, baseline_median + 3 * baseline_mad) AS threshold FROM bas)"""


def _spike_rows(spark, sf_dir):
    p = plan(spark, sf_dir, V.SPIKES)
    return p.rows, p.brands


@query(
    "a18_daily_counts",
    EV + "SELECT brand, strftime(day, '%Y-%m-%d') AS day, count(*) AS n,"
    " count(DISTINCT cluster_key) AS n_clusters FROM rel WHERE day IS NOT NULL GROUP BY ALL",
)
def daily_counts(spark, sf_dir):
    d = E.daily_counts(plan(spark, sf_dir).rows)
    return d.withColumn("day", F.col("day").cast("string"))


@query(
    "j11_calendar",
    _DAYS + "SELECT brand, strftime(day, '%Y-%m-%d') AS day, n, n_clusters FROM days",
)
def calendar(spark, sf_dir):
    d = E.filled_days(*_spike_rows(spark, sf_dir), V.NOW)
    return d.withColumn("day", F.col("day").cast("string"))


@query(
    "a19_baselines",
    _BASE + """SELECT brand, strftime(day, '%Y-%m-%d') AS day, n, n_clusters,
  baseline_median::DOUBLE AS baseline_median, baseline_mad::DOUBLE AS baseline_mad,
  threshold::DOUBLE AS threshold FROM spk""",
)
def baselines(spark, sf_dir):
    d = E.baselines(E.filled_days(*_spike_rows(spark, sf_dir), V.NOW))
    return d.withColumn("day", F.col("day").cast("string"))


_EXHIBIT = """, exh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, day
  ORDER BY engagement_score DESC, published_at DESC NULLS LAST, mention_id) AS rk
  FROM rel WHERE day IS NOT NULL) WHERE rk = 1)"""


@query(
    "p08_events",
    _BASE + _EXHIBIT + """SELECT s.brand, strftime(s.day, '%Y-%m-%d') AS date, n, n_clusters,
  baseline_median::DOUBLE AS baseline_median, baseline_mad::DOUBLE AS baseline_mad,
  threshold::DOUBLE AS threshold, s.brand AS label, url AS exhibit_url
FROM spk s JOIN exh USING (brand, day) WHERE n > 0 AND n >= threshold AND n_clusters >= 3""",
)
def spike_events(spark, sf_dir):
    d = plan(spark, sf_dir, V.SPIKES).events()
    return d.withColumn("date", F.col("date").cast("string"))


@query(
    "w05_exhibits",
    EV + _EXHIBIT + "SELECT brand, strftime(day, '%Y-%m-%d') AS day, mention_id FROM exh",
)
def exhibits(spark, sf_dir):
    d = E.exhibits(plan(spark, sf_dir).rows)
    return d.select("brand", F.col("day").cast("string").alias("day"), "mention_id")


_LARGEST = """, big AS (SELECT * FROM (SELECT brand, day, topic_id, count(*) AS n_topic,
    row_number() OVER (PARTITION BY brand, day ORDER BY count(*) DESC, topic_id) AS rk
  FROM rel WHERE topic_id IS NOT NULL AND day IS NOT NULL GROUP BY brand, day, topic_id) WHERE rk = 1)"""


@query(
    "w06_largest_topic",
    EV + _LARGEST + "SELECT brand, strftime(day, '%Y-%m-%d') AS day, topic_id, n_topic FROM big",
)
def largest_topic(spark, sf_dir):
    d = E.largest_topics(plan(spark, sf_dir).rows)
    return d.select("brand", F.col("day").cast("string").alias("day"), "topic_id", "n_topic")


@query(
    "j15_event_topic_labels",
    _BASE + _LARGEST + """SELECT s.brand, strftime(s.day, '%Y-%m-%d') AS date,
  coalesce(CASE WHEN topic_id NOT LIKE '%-02' THEN 'about ' || topic_id END, s.brand) AS label
FROM spk s LEFT JOIN big USING (brand, day) WHERE n > 0 AND n >= threshold AND n_clusters >= 3""",
)
def event_topic_labels(spark, sf_dir):
    p = plan(spark, sf_dir, V.SPIKES)
    ids = p.rows.select("topic_id").distinct().filter("topic_id not like '%-02'")
    p.topic_names = ids.select("topic_id", F.concat(F.lit("about "), "topic_id").alias("name"))
    return p.events().select("brand", F.col("date").cast("string").alias("date"), "label")


@query(
    "w04_top_mentions",
    V.with_("ev") + """SELECT brand, mention_id, engagement_score, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY brand ORDER BY engagement_score DESC, published_at DESC NULLS LAST,
    mention_id) AS rank FROM ev
  WHERE status IN ('ok', 'cached') AND about_brand AND label <> 'irrelevant') WHERE rank <= 10""",
)
def top_mentions(spark, sf_dir):
    got = E.top_mentions(V.ev_labelled(spark, sf_dir))
    return got.select("brand", "mention_id", "engagement_score", F.col("rank").cast("long").alias("rank"))


@query(
    "w14_ordered_events",
    _BASE + """SELECT brand, strftime(day, '%Y-%m-%d') AS date, n FROM spk
WHERE n > 0 AND n >= threshold AND n_clusters >= 3 ORDER BY brand, date""",
)
def ordered_events(spark, sf_dir):
    d = E.spike_days(*_spike_rows(spark, sf_dir), V.NOW)
    return d.select("brand", F.col("day").cast("string").alias("date"), "n").orderBy("brand", "date")
