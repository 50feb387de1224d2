"""Cluster bootstrap: n units drawn with replacement, one shared draw for every estimate.

Units that carry the same cells are exchangeable, so only how often each *kind* of unit was drawn
matters. Units are first reduced to kinds with a multiplicity; what follows depends on the number
of kinds, not of mentions. Two exact ways to draw:

* ``counter``: draw j of iteration b takes unit ``md5(seed:stream:b:j) mod n``. A pure function of
  its key, independent of partitions and easy to replay in SQL. Costs iterations x units draws, which
  are made and counted as arrays (``draws``).
* ``multinomial``: one multinomial draw per iteration over the kinds, first over groups of kinds,
  then within each group. The same distribution at a cost that does not grow with the units.

The caller chooses; neither changes into the other with the size of the input.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions.scalars import design_effect
from earshot.operators import draws as D
from earshot.operators.frame import CELL
from earshot.operators.ranking import bucketed_running_total
from earshot.settings import keep

KINDS_PER_GROUP = 4096
ITERATIONS_PER_TASK = 250
_MAX_GROUPS = 4096
_DRAWN = "b long, key string, cell string, w long"


def cell_key():
    """One string per cell; nulls (undated, no polarity) are written as a dash."""
    return F.concat_ws(
        "|",
        F.coalesce("source", F.lit("-")),
        F.coalesce("period", F.lit("-")),
        F.coalesce("polarity", F.lit("-")),
        F.when(F.col("confirmed"), "1").otherwise("0"),
    )


def split_cell(df: DataFrame) -> DataFrame:
    """Back from the string to the four columns."""
    parts = F.split("cell", r"\|")
    blank = lambda i: F.when(parts[i] != "-", parts[i])
    return df.withColumns(
        {"source": blank(0), "period": blank(1), "polarity": blank(2), "confirmed": parts[3] == "1"}
    ).drop("cell")


def unit_kinds(cells: DataFrame, key: str = "brand") -> DataFrame:
    """Kinds of cluster units: equal cell counts under one ``key``. A unit has few cells."""
    units = (
        cells.withColumn("cell", cell_key())
        .groupBy(key, "cluster_key")
        .agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    )
    written = F.array_join(
        F.transform("cells", lambda c: F.concat(c["cell"], F.lit("="), c["n"])), ","
    )
    return _kinds(units.withColumn("written", written), key, F.count(F.lit(1)))


def row_kinds(cells: DataFrame, key: str = "brand") -> DataFrame:
    """B02. Kinds of single rows: the unit is the row."""
    rows = cells.withColumn("cell", cell_key()).withColumns(
        {
            "cells": F.array(F.struct("cell", F.lit(1).cast("long").alias("n"))),
            "written": F.concat("cell", F.lit("=1")),
        }
    )
    return _kinds(rows, key, F.sum("n"))


def _kinds(units: DataFrame, key: str, multiplicity) -> DataFrame:
    return (
        units.groupBy(F.col(key).alias("key"), "written")
        .agg(multiplicity.alias("m"), F.first("cells").alias("cells"))
        .withColumn("kind", F.md5(F.concat(F.col("key"), F.lit("\n"), F.col("written"))))
        .drop("written")
    )


def resample(
    kinds: DataFrame,
    b: int = config.B_LIVE,
    seed: int = config.SEED,
    stream: str = "c",
    method: str = "multinomial",
) -> DataFrame:
    """B01. Weighted cell totals per iteration: (b, key, source, period, polarity, confirmed, w)."""
    if b < 1:
        raise ValueError("b must be at least 1")
    kinds = keep(kinds)
    size = kinds.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("t")).first()
    n, t = size["n"] or 0, size["t"]
    if n == 0:
        drawn = kinds.sparkSession.createDataFrame([], _DRAWN)
    elif method == "counter":
        drawn = _counter_draws(kinds, n, t, b, seed, stream)
    elif method == "multinomial":
        drawn = _multinomial_draws(kinds, n, t, b, seed, stream)
    else:
        raise ValueError(f"unknown method {method!r}")
    totals = drawn.groupBy("b", "key", "cell").agg(F.sum("w").alias("w"))
    return split_cell(totals)


def draw_index(seed: int, stream: str, n: int):
    """The unit that draw j of iteration b takes."""
    text = F.concat_ws(":", F.lit(seed), F.lit(stream), F.col("b"), F.col("j"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(n)


#: Kinds that hold at least this share of the units are counted where their draws are made.
_FREQUENT = 10_000


def _counter_draws(kinds, n, t, b, seed, stream):
    """Kind k holds the positions [lo, lo + m); it and the draws of its positions meet in their chunk."""
    spark = kinds.sparkSession
    width = D.chunk_width(b)
    laid_out = keep(bucketed_running_total(kinds, [F.substring("kind", 1, 2)], [F.col("kind")], "m", "lo"))
    # Kinds of many units would fill chunks with their draws. There are _FREQUENT at most.
    bound = max(width // 8, n // _FREQUENT)
    frequent = laid_out.filter(F.col("m") > bound).select("lo", "m").orderBy("lo").collect()
    starts = np.array([row["lo"] for row in frequent], dtype=np.int64)
    ends = starts + np.array([row["m"] for row in frequent], dtype=np.int64)
    numbers = spark.createDataFrame([(row["lo"], -1 - i) for i, row in enumerate(frequent)], "lo long, chunk long")
    cells = laid_out.select("lo", (F.col("lo") + F.col("m")).alias("hi"), "key", "m", F.explode("cells").alias("c"))
    cells = cells.select("lo", "hi", "key", "m", F.col("c.cell").alias("cell"), F.col("c.n").alias("n"))
    of_frequent = cells.filter(F.col("m") > bound).join(F.broadcast(numbers), "lo")
    at = lambda position: F.floor(position / width).cast("long")
    others = cells.filter(F.col("m") <= bound).withColumn(
        "chunk", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") - 1)))
    )
    held = others.select("chunk", "lo", "hi", "key", "cell", "n").unionByName(
        of_frequent.select("chunk", "lo", "hi", "key", "cell", "n")
    )
    each = -(-n // D.STRETCH)
    parts = min(b * each, max(spark.sparkContext.defaultParallelism, b * each // 16))
    tasks = spark.range(0, b * each, 1, parts).select(
        F.floor(F.col("id") / each).alias("b"), (F.col("id") % each * D.STRETCH).alias("first"), F.lit(n).cast("long").alias("n")
    ).withColumn("text", F.concat(F.lit(f"{seed}:{stream}:"), F.col("b"), F.lit(":")))
    drawn = D.packed_draws(tasks, [], width, (starts, ends))

    def count(draws: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"b": [], "key": [], "cell": [], "w": []}
        if len(draws) and len(rows):
            chunk = int(rows["chunk"].iloc[0])
            column, names = pd.factorize(pd.MultiIndex.from_frame(rows[["key", "cell"]]))
            amount = rows["n"].to_numpy(dtype=np.int64)
            lo, hi = (np.clip(rows[c].to_numpy() - chunk * width, 0, width) for c in ("lo", "hi"))
            if chunk < 0:
                times = ((b_, np.full(len(rows), total)) for b_, total in draws.groupby("b")["times"].sum().items())
            else:
                summed = ((b_, np.concatenate([[0], np.cumsum(c)])) for b_, c in D.times_drawn(draws, width))
                times = ((b_, c[hi] - c[lo]) for b_, c in summed)
            for b_, taken in times:
                # Sums of counts, exact below 2**53.
                total = np.bincount(column, weights=taken * amount, minlength=len(names)).astype(np.int64)
                hit = np.flatnonzero(total)
                out["b"] += [b_] * len(hit)
                out["key"] += [names[i][0] for i in hit]
                out["cell"] += [names[i][1] for i in hit]
                out["w"] += total[hit].tolist()
        return pd.DataFrame(out)

    return drawn.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInPandas(count, _DRAWN)


def _multinomial_draws(kinds, n, t, b, seed, stream):
    n_groups = int(min(_MAX_GROUPS, max(1, -(-t // KINDS_PER_GROUP))))
    grouped = kinds.withColumn("g", F.pmod(F.xxhash64("kind"), F.lit(n_groups)).cast("int"))
    # One number per group reaches the driver: at most _MAX_GROUPS of them.
    totals = np.zeros(n_groups, dtype=np.int64)
    for row in grouped.groupBy("g").agg(F.sum("m").alias("m")).collect():
        totals[row["g"]] = row["m"]
    shares = totals / totals.sum()
    salt = sum(ord(ch) << (8 * i) for i, ch in enumerate(stream[:4]))
    starts = [F.lit(s) for s in range(0, b, ITERATIONS_PER_TASK)]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kind", ignore_index=True)
        group, start = int(pdf["g"].iloc[0]), int(pdf["start"].iloc[0])
        m = pdf["m"].to_numpy(dtype=np.int64)
        columns: dict[tuple[str, str], int] = {}
        at_row, at_col, amount = [], [], []
        for row, (key, cells) in enumerate(zip(pdf["key"], pdf["cells"])):
            for cell in cells:
                at_row.append(row)
                at_col.append(columns.setdefault((key, cell["cell"]), len(columns)))
                amount.append(cell["n"])
        at_row, at_col = np.array(at_row), np.array(at_col)
        amount = np.array(amount, dtype=np.int64)
        out = []
        for i in range(start, min(start + ITERATIONS_PER_TASK, b)):
            split = np.random.default_rng([seed, salt, i]).multinomial(n, shares)
            inner = np.random.default_rng([seed, salt, i, group])
            times = inner.multinomial(split[group], m / m.sum())
            sums = np.zeros(len(columns), dtype=np.int64)
            np.add.at(sums, at_col, times[at_row] * amount)
            out.append(sums)
        keys = list(columns)
        return pd.DataFrame(
            {
                "b": np.repeat(np.arange(start, start + len(out)), len(keys)),
                "key": [k for k, _ in keys] * len(out),
                "cell": [c for _, c in keys] * len(out),
                "w": np.concatenate(out),
            }
        )

    return (
        grouped.withColumn("start", F.explode(F.array(*starts)))
        .groupBy("g", "start")
        .applyInPandas(draw, _DRAWN)
    )


def percentile_interval(draws: str, level: float = config.CI_LEVEL):
    """A20. [lo, hi] over the defined draws, linear between neighbours."""
    tail = (1.0 - level) / 2.0
    return F.percentile(draws, F.array(F.lit(tail), F.lit(1.0 - tail)))


def two_sided_p(draws: str):
    """A21. min(1, 2 min(P(d <= 0), P(d >= 0))) over the defined draws."""
    d = F.col(draws)
    return F.least(
        F.lit(1.0),
        2.0
        * F.least(
            F.avg(F.when(d <= 0, 1.0).when(d.isNotNull(), 0.0)),
            F.avg(F.when(d >= 0, 1.0).when(d.isNotNull(), 0.0)),
        ),
    )


def dense_iterations(keys: DataFrame, b: int) -> DataFrame:
    """One row per key and iteration. An iteration that never drew a key still counts as zero."""
    return keys.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)).cast("array<long>")))


__all__ = [
    "CELL", "cell_key", "design_effect", "dense_iterations", "draw_index", "percentile_interval",
    "resample", "row_kinds", "two_sided_p", "unit_kinds",
]
