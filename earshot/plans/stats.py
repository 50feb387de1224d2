"""B08. Share of voice, net sentiment, per-source sentiment, verdicts and events in one plan."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import scalars as S
from earshot.operators import bootstrap as B
from earshot.operators import frame as R
from earshot.operators import verdicts
from earshot.operators.events import detect_events


def _in(period):
    return F.col("period") == period


def _kept(make):
    """Build once per plan and keep: a table with a row per brand, or per brand and source."""

    def once(self) -> DataFrame:
        return self._once(make.__name__, lambda: make(self))

    once.__doc__ = make.__doc__
    return once


class StatsPlan:
    """All statistics of one session, as lazy DataFrames over shared pre-aggregates.

    Kept while the plan is in use (``close`` drops them): the unit cells, both sets of draws with one
    row per iteration and cell, and the tables with one row per brand that several results read.

    ``labelled`` holds mentions joined with labels, ``brands`` the compared brands in order,
    ``basis`` the sources every brand returned. Draws are made once and read by every estimate.
    """

    def __init__(
        self,
        labelled: DataFrame,
        brands: DataFrame,
        basis: Sequence[str],
        now: datetime,
        b: int = config.B_LIVE,
        seed: int = config.SEED,
        method: str = "multinomial",
        topic_names: DataFrame | None = None,
    ):
        self.labelled, self.brands, self.basis, self.now = labelled, brands, basis, now
        self.b, self.seed, self.method, self.topic_names = b, seed, method, topic_names
        # Sent to every task: a join by exchange would put all rows of a brand, and then its cells, into one.
        self.rows = R.stats_rows(labelled, now).join(
            F.broadcast(brands.select("brand")), "brand", "left_semi"
        )
        # Kept: a few rows per unit, and every estimate and both resamples start from them.
        self.cells = R.unit_cells(self.rows).persist()
        self.marked = R.mark_basis(self.cells, basis)
        self._cache: dict[str, DataFrame] = {}

    def _once(self, name, make) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = make().persist()
        return self._cache[name]

    def close(self) -> None:
        """Drop what was kept."""
        for kept in (self.cells, *self._cache.values()):
            kept.unpersist()
        self._cache.clear()

    # -- points ---------------------------------------------------------------------------------
    def counts(self) -> DataFrame:
        """A05-A07 per brand, basis sources and all sources."""
        return self._once("counts", lambda: R.brand_counts(self.marked, self.brands))

    @_kept
    def share_points(self) -> DataFrame:
        """A07. Share over basis sources; brands below the minimums stay in the denominator."""
        everyone = Window.partitionBy()
        total = lambda column: F.sum(column).over(everyone)
        share = S.ratio("n_basis", total("n_basis"))
        delta = S.ratio("cur_basis", total("cur_basis")) - S.ratio(
            "prev_basis", total("prev_basis")
        )
        return (
            self.counts()
            .withColumns(
                {
                    "level_detail": R.below_minimum("share", "basis", False),
                    "wow_detail": R.below_minimum("share", "basis", True),
                    "share_all": share,
                    "delta_all": delta,
                }
            )
            .select(
                "brand",
                "brand_order",
                F.col("n_basis").alias("n"),
                F.col("clusters_n_basis").alias("n_clusters"),
                F.when(F.col("level_detail").isNull(), F.col("share_all")).alias("share"),
                F.when(F.col("wow_detail").isNull(), F.col("delta_all")).alias("delta"),
                "level_detail",
                "wow_detail",
            )
        )

    @_kept
    def net_points(self) -> DataFrame:
        """A03, A08, A09. Polarity counts and net over all sources, undated rows included."""
        n, confirmed = F.col("n"), F.col("confirmed")
        sums = self.cells.groupBy("brand").agg(
            *R.polarity_sums(n),
            *R.polarity_sums(n, _in("current"), "_cur"),
            *R.polarity_sums(n, _in("previous"), "_prev"),
            F.sum(F.when(confirmed, n).otherwise(0)).alias("n_confirmed"),
        )
        zero = [c for c in sums.columns if c != "brand"]
        joined = self.counts().join(sums, "brand", "left").fillna(0, subset=zero)
        return joined.select(
            "brand",
            "brand_order",
            F.col("n_all").alias("n"),
            F.col("clusters_n_all").alias("n_clusters"),
            "n_confirmed",
            "pos",
            "neg",
            "neu",
            S.net("pos", "neg", "neu").alias("net_all"),
            (
                S.net("pos_cur", "neg_cur", "neu_cur") - S.net("pos_prev", "neg_prev", "neu_prev")
            ).alias("delta_all"),
            R.below_minimum("net", "all", False).alias("level_detail"),
            R.below_minimum("net", "all", True).alias("wow_detail"),
        )

    @_kept
    def source_points(self) -> DataFrame:
        """A04, A10. Every brand with every basis source, zero rows included."""
        per_unit = self.cells.groupBy("brand", "source", "cluster_key").agg(
            F.sum("n").alias("n"), *R.polarity_sums(F.col("n"))
        )
        sums = per_unit.groupBy("brand", "source").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("n_clusters"),
            *[F.sum(c).alias(c) for c in ("pos", "neg", "neu")],
        )
        every = F.array(*[F.lit(source) for source in self.basis]).cast("array<string>")
        grid = self.brands.select("brand", "brand_order", F.explode(every).alias("source"))
        filled = grid.join(sums, ["brand", "source"], "left").fillna(
            0, subset=["n", "n_clusters", "pos", "neg", "neu"]
        )
        scoped = filled.join(R.wow_scope(self.labelled), ["brand", "source"], "left")
        return scoped.withColumns(
            {
                "net": S.net("pos", "neg", "neu"),
                "wow_scope": F.coalesce("wow_scope", F.lit(True)),
            }
        )

    # -- draws ----------------------------------------------------------------------------------
    def cluster_draws(self) -> DataFrame:
        return self._once(
            "cluster",
            lambda: B.resample(
                B.unit_kinds(self.cells), self.b, self.seed, "c", self.method
            ).withColumnRenamed("key", "brand"),
        )

    def iid_draws(self) -> DataFrame:
        return self._once(
            "iid",
            lambda: B.resample(
                B.row_kinds(self.cells), self.b, self.seed, "i", self.method
            ).withColumnRenamed("key", "brand"),
        )

    def share_draws(self) -> DataFrame:
        """B03, B05. Share and its week-over-week change, per iteration and brand."""
        in_basis = R.mark_basis(self.cluster_draws(), self.basis).filter("in_basis")
        w = F.col("w")
        sums = in_basis.groupBy("b", "brand").agg(
            F.sum(w).alias("full"),
            F.sum(F.when(_in("current"), w)).alias("cur"),
            F.sum(F.when(_in("previous"), w)).alias("prev"),
        )
        dense = (
            B.dense_iterations(self.brands.select("brand"), self.b)
            .join(sums, ["b", "brand"], "left")
            .fillna(0, subset=["full", "cur", "prev"])
        )
        everyone = Window.partitionBy("b")
        share = lambda c: S.ratio(c, F.sum(c).over(everyone))
        return dense.select(
            "b", "brand", share("full").alias("share"), (share("cur") - share("prev")).alias("delta")
        )

    @staticmethod
    def _net_draws(draws: DataFrame) -> DataFrame:
        w, confirmed = F.col("w"), F.col("confirmed")
        sums = draws.groupBy("b", "brand").agg(
            *R.polarity_sums(w),
            *R.polarity_sums(w, _in("current"), "_cur"),
            *R.polarity_sums(w, _in("previous"), "_prev"),
            *R.polarity_sums(w, _in("current") & confirmed, "_ccur"),
            *R.polarity_sums(w, _in("previous") & confirmed, "_cprev"),
        )
        at = lambda s: S.net(f"pos{s}", f"neg{s}", f"neu{s}")
        return sums.select(
            "b",
            "brand",
            at("").alias("net"),
            (at("_cur") - at("_prev")).alias("delta"),
            (at("_ccur") - at("_cprev")).alias("delta_confirmed"),
        )

    def net_draws(self) -> DataFrame:
        """B04, B05. Net and its change, full set and confirmed only, per iteration and brand."""
        return self._net_draws(self.cluster_draws())

    @_kept
    def net_changes(self) -> DataFrame:
        """A20, A21 per brand, from the draws of clusters alone: all that a verdict needs."""
        cluster = self.net_draws().groupBy("brand").agg(
            B.percentile_interval("net").alias("ci"),
            B.percentile_interval("delta").alias("dci"),
            B.percentile_interval("delta_confirmed").alias("cci"),
            B.two_sided_p("delta").alias("p_raw"),
        )
        return cluster.select(
            "brand",
            *_ends("ci", "ci_lo", "ci_hi"),
            *_ends("dci", "lo", "hi"),
            *_ends("cci", "conf_lo", "conf_hi"),
            "p_raw",
        )

    @_kept
    def net_intervals(self) -> DataFrame:
        """A20, A21, F35 per brand; the design effect also takes the draws of single rows."""
        iid = self._net_draws(self.iid_draws()).groupBy("brand").agg(
            B.percentile_interval("net").alias("ici")
        )
        return self.net_changes().join(iid, "brand", "left").select(
            "brand", "ci_lo", "ci_hi",
            *_ends("ici", "iid_lo", "iid_hi"),
            "lo", "hi", "conf_lo", "conf_hi", "p_raw",
            S.design_effect("ci_lo", "ci_hi", F.col("ici")[0], F.col("ici")[1]).alias("design_effect"),
        )

    @_kept
    def share_intervals(self) -> DataFrame:
        draws = self.share_draws().groupBy("brand").agg(
            B.percentile_interval("share").alias("ci"),
            B.percentile_interval("delta").alias("dci"),
            B.two_sided_p("delta").alias("p_raw"),
        )
        return draws.select(
            "brand", *_ends("ci", "ci_lo", "ci_hi"), *_ends("dci", "lo", "hi"), "p_raw"
        )

    @_kept
    def source_intervals(self) -> DataFrame:
        """B04 per (brand, source)."""

        def interval(draws, name):
            sums = draws.groupBy("b", "brand", "source").agg(*R.polarity_sums(F.col("w")))
            nets = sums.withColumn("net", S.net("pos", "neg", "neu"))
            return nets.groupBy("brand", "source").agg(B.percentile_interval("net").alias(name))

        joined = interval(self.cluster_draws(), "ci").join(
            interval(self.iid_draws(), "ici"), ["brand", "source"], "left"
        )
        return joined.select(
            "brand",
            "source",
            *_ends("ci", "ci_lo", "ci_hi"),
            *_ends("ici", "iid_lo", "iid_hi"),
            S.design_effect(*[F.col(c)[i] for c in ("ci", "ici") for i in (0, 1)]).alias(
                "design_effect"
            ),
        )

    # -- decisions ------------------------------------------------------------------------------
    def tests(self) -> DataFrame:
        """B06. The family: net tests in brand order, then share tests, with their verdicts."""

        def make():
            null = F.lit(None).cast("double")
            net = self.net_points().join(self.net_changes(), "brand", "left").select(
                "brand",
                F.lit("net").alias("estimand"),
                F.struct(F.lit(0).alias("family"), "brand_order").alias("position"),
                F.col("wow_detail").alias("below_minimum"),
                *_unless("wow_detail", ("delta_all", "delta"), "lo", "hi", "p_raw"),
                *_unless("wow_detail", "conf_lo", "conf_hi"),
                "n_confirmed",
            )
            share = self.share_points().join(self.share_intervals(), "brand", "left").select(
                "brand",
                F.lit("share").alias("estimand"),
                F.struct(F.lit(1).alias("family"), "brand_order").alias("position"),
                F.col("wow_detail").alias("below_minimum"),
                "delta",
                *_unless("wow_detail", "lo", "hi", "p_raw"),
                null.alias("conf_lo"),
                null.alias("conf_hi"),
                F.lit(None).cast("long").alias("n_confirmed"),
            )
            no_confirmed = F.col("n_confirmed") == 0
            family = net.unionByName(share).withColumns(
                {c: F.when(~F.coalesce(no_confirmed, F.lit(False)), F.col(c)) for c in ("conf_lo", "conf_hi")}
            )
            return verdicts.decide(verdicts.holm(family))

        return self._once("tests", make)

    # -- tables ---------------------------------------------------------------------------------
    def share_of_voice(self) -> DataFrame:
        wow = self.tests().filter("estimand = 'share'").select(
            "brand", F.struct("delta", "lo", "hi", "verdict", "p_raw", "p_holm").alias("wow")
        )
        basis = F.array(*[F.lit(source) for source in self.basis]).cast("array<string>")
        points = self.share_points().select("brand", "n", "n_clusters", "share", "level_detail")
        intervals = self.share_intervals().select("brand", "ci_lo", "ci_hi")
        return (
            points.join(intervals, "brand", "left")
            .join(wow, "brand", "left")
            .select(
                "brand", "n", "n_clusters",
                F.when(F.col("ci_lo").isNotNull(), F.col("share")).alias("share"),
                *_unless("level_detail", "ci_lo", "ci_hi"),
                basis.alias("basis_sources"), "wow",
            )
        )

    def sentiment(self) -> DataFrame:
        wow = self.tests().filter("estimand = 'net'").select(
            "brand",
            F.struct(
                "delta", "lo", "hi", "conf_lo", "conf_hi", "verdict", "p_raw", "p_holm"
            ).alias("wow"),
        )
        intervals = self.net_intervals().select(
            "brand", "ci_lo", "ci_hi", "iid_lo", "iid_hi", "design_effect"
        )
        return (
            self.net_points()
            .join(intervals, "brand", "left")
            .join(wow, "brand", "left")
            .select(
                "brand", "n", "n_confirmed", "pos", "neg", "neu",
                *_unless(
                    "level_detail", ("net_all", "net"),
                    "ci_lo", "ci_hi", "iid_lo", "iid_hi", "design_effect",
                ),
                "wow",
            )
        )

    def by_source(self) -> DataFrame:
        return (
            self.source_points()
            .join(self.source_intervals(), ["brand", "source"], "left")
            .select(
                "brand", "source", "n", "n_clusters", "pos", "neg", "neu", "net",
                "ci_lo", "ci_hi", "iid_lo", "iid_hi", "design_effect", "wow_scope",
            )
        )

    def events(self) -> DataFrame:
        return detect_events(self.rows, self.brands, self.now, self.topic_names)

    def abstentions(self) -> DataFrame:
        """B06. Why a word, an interval or an estimate is missing."""
        no_width = lambda what: F.concat(what, F.lit(" design_effect: iid ci95 has zero width"))
        sentiment = self.net_points().join(self.net_intervals(), "brand", "left")
        level = sentiment.filter("level_detail is null").select(
            F.lit("brand").alias("scope"), "brand", F.lit(None).cast("string").alias("source"),
            F.lit("degenerate").alias("reason"),
            F.when(F.col("pos") + F.col("neg") + F.col("neu") == 0, "net: pos + neg + neu = 0")
            .when(F.col("ci_lo").isNull() | F.col("iid_lo").isNull(), "net: no defined bootstrap draw")
            .when(F.col("design_effect").isNull(), no_width(F.lit("net")))
            .alias("detail"),
        )
        what = F.concat(F.lit("by_source "), "source", F.lit(" net"))
        sources = self.by_source().select(
            F.lit("brand").alias("scope"), "brand", "source",
            F.lit("degenerate").alias("reason"),
            F.when(F.col("n") == 0, F.concat(what, F.lit(": no relevant mentions")))
            .when(F.col("net").isNull(), F.concat(what, F.lit(": pos + neg + neu = 0")))
            .when(F.col("ci_lo").isNull() | F.col("iid_lo").isNull(), F.concat(what, F.lit(": no defined bootstrap draw")))
            .when(F.col("design_effect").isNull(), no_width(what))
            .alias("detail"),
        )
        family = verdicts.family_abstentions(self.tests()).drop("order")
        return family.unionByName(level.filter("detail is not null")).unionByName(
            sources.filter("detail is not null")
        )

    def unchecked(self) -> DataFrame:
        """Notes on (brand, source) pairs without a single dated item."""
        note = F.concat(
            "source", F.lit(": items lacking a timestamp, excluded from WoW and events ("),
            "brand", F.lit(")"),
        )
        return self.source_points().filter("not wow_scope").select("brand", "source", note.alias("note"))

    def tables(self) -> dict[str, DataFrame]:
        return {
            "share_of_voice": self.share_of_voice(),
            "sentiment": self.sentiment(),
            "by_source": self.by_source(),
            "events": self.events(),
            "abstentions": self.abstentions(),
            "what_could_not_be_checked": self.unchecked(),
        }


def _ends(array: str, lo: str, hi: str):
    return F.col(array)[0].alias(lo), F.col(array)[1].alias(hi)


def _unless(detail: str, *columns):
    """The columns, nulled where ``detail`` states a missed minimum; a pair renames."""
    out = []
    for column in columns:
        name, alias = column if isinstance(column, tuple) else (column, column)
        out.append(F.when(F.col(detail).isNull(), F.col(name)).alias(alias))
    return out
