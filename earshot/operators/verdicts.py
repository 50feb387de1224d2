"""Holm step-down and the family decision over all week-over-week tests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import scalars as S


def holm(tests: DataFrame, family=(), p="p_raw", position="position", out="p_holm") -> DataFrame:
    """W09. Adjusted p per test; null tests stay null and do not count.

    A family has two tests per compared brand, so one window per family is small.
    """
    within = Window.partitionBy(*family)
    ordered = within.orderBy(F.col(p).asc_nulls_last(), F.col(position))
    rank = F.row_number().over(ordered)
    m = F.count(p).over(within)
    step = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_step", step).withColumn(
        out, F.when(F.col(p).isNotNull(), F.max("_step").over(running))
    ).drop("_step")


def decide(tests: DataFrame) -> DataFrame:
    """B06. Verdict per test, from delta, both intervals, p_raw, p_holm and the minimums text."""
    undefined = (
        F.col("delta").isNull() | F.col("lo").isNull() | F.col("p_raw").isNull()
        | F.col("p_holm").isNull()
    )
    verdict = S.wow_verdict(
        "delta", "lo", "hi", "conf_lo", "conf_hi", "p_raw", "p_holm", F.col("estimand") == "share"
    )
    out = F.col("below_minimum").isNotNull() | undefined
    kept = ["delta", "lo", "hi", "conf_lo", "conf_hi", "p_raw", "p_holm"]
    return tests.withColumn("_out", out).withColumns(
        {"verdict": F.when(F.col("_out"), "ABSTAIN").otherwise(verdict)}
        | {name: F.when(~F.col("_out"), F.col(name)) for name in kept}
    ).drop("_out")


def family_abstentions(decided: DataFrame) -> DataFrame:
    """B06. One row per reason a test has no word or no confirmed-only interval."""
    net = F.col("estimand") == "net"
    abstained = F.col("verdict") == "ABSTAIN"
    below = F.col("below_minimum").isNotNull()
    undefined = ~below & F.col("delta").isNull()
    row = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))
    interval = lambda lo, hi: F.concat(F.lit("["), F.col(lo), F.lit(", "), F.col(hi), F.lit("]"))
    rows = F.filter(
        F.array(
            F.when(below, row("below_minimum", F.col("below_minimum"))),
            F.when(
                undefined,
                row("degenerate", F.concat("estimand", F.lit(" WoW: no defined bootstrap draw"))),
            ),
            F.when(
                net & ~below & ~undefined & F.col("conf_lo").isNull(),
                row(
                    "degenerate",
                    F.concat(
                        F.lit("ci95_confirmed_only: n_confirmed = "),
                        F.col("n_confirmed"),
                        F.when(F.col("n_confirmed") == 0, "").otherwise(
                            " but no defined confirmed-only draw"
                        ),
                    ),
                ),
            ),
            F.when(
                net & abstained & ~below & ~undefined,
                row(
                    "signals_conflict",
                    F.concat(
                        F.lit("net WoW: full-set ci95="), interval("lo", "hi"),
                        F.lit(" and confirmed-only ci95="), interval("conf_lo", "conf_hi"),
                        F.lit(" exclude 0 with opposite signs"),
                    ),
                ),
            ),
        ),
        lambda r: r.isNotNull(),
    )
    return decided.select("brand", "position", F.posexplode(rows).alias("at", "r")).select(
        F.lit("brand").alias("scope"), "brand", F.lit(None).cast("string").alias("source"),
        "r.reason", "r.detail", F.struct("position", "at").alias("order"),
    )
