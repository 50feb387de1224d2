"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Among all document rates between 0 and ``most`` that take the
target's words, those are chosen that stay closest to 1 in relative entropy. Their dual has one price
a source, and a document of ``size`` words in a source with price p has the rate
``min(most, exp(p * size / mean size))``: an exponential tilt of its length. Newton steps, each kept
between the best known bounds, solve the convex dual of all sources at once.

Documents of one source and size have one rate, so every step reads a table of counts by source and
size, made once with a partial aggregate, and not the documents. Sums are decimals, so their order
does not matter and reruns agree.

Rates become copies along the sizes of a source, from long to short: a size gets as many copies as
the running sum of rates passes whole numbers there, which keeps the words taken within one longest
document of the target. What is still missing or too much is then made up by single copies, the
longest that fit first, of one size for each power of two. A size's copies go round its documents;
those that get one more are the first by hash of the id.

Ranks inside a size are counted in parts of about ``PART_ROWS`` rows, and an id that repeats more often
than that is a group of its own with parts cut anywhere, as its rows have equal results.

Odd input: a null text has no words; documents without words are taken once and count nothing. A null
source is a source, the last one. Repeated rows are documents of their own. An empty table gives an
empty one. Input columns with the name of a computed one give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import common as C
from earshot.operators.ranking import bucketed_rank, range_bucket

#: Weights of the sources in code-point order, repeating, and the most copies of a document on average.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a size that are ranked together, about.
PART_ROWS = 2_000
#: Rows of a small side that is sent to every worker, at most.
MAX_BROADCAST_ROWS = 200_000
#: Newton steps, at most, and the relative error of a source's words at which they end.
STEPS = 80
TOLERANCE = 1e-9

_RATE = "decimal(14,12)"
_SUM = "decimal(38,12)"


def words(text_col: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _side(df: DataFrame) -> DataFrame:
    """A checkpointed table as a join side: sent to every worker while it is small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds the target of each source (source, n_docs, source_size).

    Sources share all words by weight; a target stops at ``most`` times its source's size, and what is
    beyond is shared by weight among the others until none is above. Each round raises the level (words
    a unit of weight) to what is left for the sources that are not full; a round brings three numbers to
    the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranked = bucketed_rank(sources, [], [F.col("source").isNull(), range_bucket(sources, "source")], [order], "place")
    # A null text column has bucket -1, but nulls come last: the first bucket column says so.
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighted = ranked.select("source", "n_docs", "source_size", cycle.alias("weight")).checkpoint()
    full = F.col("source_size").cast("double") * most
    total, shares = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level, known = (float(total) / shares if total else 0.0), 0
    while total:
        at_most = full <= F.col("weight") * level
        n, taken, free = weighted.agg(
            F.count_if(at_most), F.coalesce(F.sum(F.when(at_most, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~at_most, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == known or not free:
            break
        known, level = n, (float(total) - most * float(taken)) / free
    return weighted.withColumn("target", F.least(full, F.col("weight") * level))


def _tilt(price: str = "price", most: float = MOST) -> Column:
    """Rate of a document; the exponent is bounded so that no power overflows."""
    power = F.least(F.col(price) * F.col("size") / F.col("scale"), F.lit(50.0))
    rate = F.when(F.col("full") & (F.col("size") > 0), F.lit(float(most))).otherwise(F.least(F.exp(power), F.lit(float(most))))
    return rate.cast(_RATE)


def solve(cells: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """Prices of the sources: columns of ``sources`` with ``price``, ``scale`` and ``full``.

    ``cells`` has (source, size, n), ``sources`` (source, n_docs, source_size, target).
    """
    size, goal = F.col("source_size").cast("double"), F.col("target")
    state = sources.select(
        "*",
        F.lit(0.0).alias("price"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        F.greatest(size / F.col("n_docs"), F.lit(1e-9)).alias("scale"),
        (goal >= size * most * (1 - TOLERANCE)).alias("full"),
        F.lit(False).alias("done"),
    ).checkpoint()
    for _ in range(STEPS):
        open_ = state.where("NOT (done OR `full`)").select(F.col("source").alias("s"), "price", "scale", "full")
        rated = cells.join(_side(open_.checkpoint()), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _tilt(most=most))
        taken = (F.col("n") * F.col("size")).cast("decimal(24,0)") * F.col("rate")
        slope = F.when(F.col("rate") < most, (taken.cast("double") * F.col("size") / F.col("scale")).cast(_SUM))
        sums = rated.groupBy("s").agg(F.sum(taken).cast("double").alias("taken"), F.coalesce(F.sum(slope).cast("double"), F.lit(0.0)).alias("slope"))
        held = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        short = F.col("taken") < goal
        held = held.withColumns({"low": F.when(short, F.col("price")).otherwise(F.col("low")), "high": F.when(short, F.col("high")).otherwise(F.col("price"))})
        newton = F.col("price") - (F.col("taken") - goal) / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        # A step out of the bounds halves them; without the upper one it doubles the price.
        middle = F.when(F.col("high").isNull(), F.col("price") * 2 + 1).when(F.col("low").isNull(), F.col("price") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("taken").isNull() | (F.abs(F.col("taken") - goal) <= goal * TOLERANCE) | (F.col("high") - F.col("low") < 1e-13)
        moved = F.when(done, F.col("price")).when(inside, newton).otherwise(middle)
        state = held.withColumns({"done": F.col("done") | F.coalesce(done, F.lit(False)), "price": moved}).select(*state.columns).checkpoint()
        if state.where("NOT (done OR `full`)").isEmpty():
            break
    return state.drop("low", "high", "done")


def _copies(cells: DataFrame, prices: DataFrame, most: int) -> DataFrame:
    """Copies ``k`` of all documents of each cell, at most ``most`` each."""
    known = prices.withColumnRenamed("source", "s")
    rated = cells.join(_side(known.checkpoint()), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", _tilt(most=most))
    along = Window.partitionBy("source").orderBy(F.desc("size"), F.asc_nulls_first("hot"))
    mass = F.sum((F.col("n").cast("decimal(20,0)") * F.col("rate")).cast(_SUM))
    upto = mass.over(along.rowsBetween(Window.unboundedPreceding, 0))
    passed = rated.withColumn("upto", F.floor(upto + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    k = F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0))
    # Documents without words take no part in the sum.
    rounded = passed.withColumn("k", F.when(F.col("size") == 0, F.col("n")).otherwise(k)).drop("upto").checkpoint()
    return _made_up(rounded, most)


def _made_up(cells: DataFrame, most: int) -> DataFrame:
    """Copies changed so that each source's words come as near its target as single copies allow."""
    taken = cells.groupBy("source").agg(F.sum(F.col("k") * F.col("size")).alias("taken"), F.first("target").alias("goal"))
    gaps = taken.select(F.col("source").alias("s"), F.round(F.col("goal") - F.col("taken")).cast("long").alias("gap")).where("gap != 0").checkpoint()
    room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("k")).otherwise(F.col("k"))
    able = cells.join(_side(gaps), F.col("source").eqNullSafe(F.col("s"))).withColumn("room", room).where("size > 0 AND room > 0 AND size <= abs(gap)")
    # One size for each power of two: at most 64 a source.
    best = able.groupBy("s", "gap", F.floor(F.log2("size")).alias("power")).agg(F.max_by(F.struct("size", "room", "cell"), F.struct("room", F.negative("size"), F.negative("cell"))).alias("x"))
    steps = F.reverse(F.array_sort(F.collect_list("x")))
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<struct<cell: bigint, add: bigint>>").alias("made"))

    def give(state: Column, x: Column) -> Column:
        add = F.least(x["room"], F.floor(state["left"] / x["size"])).cast("long")
        return F.struct((state["left"] - add * x["size"]).alias("left"), F.array_append(state["made"], F.struct(x["cell"].alias("cell"), add.alias("add"))).alias("made"))

    given = best.groupBy("s", "gap").agg(steps.alias("steps")).select(F.sign("gap").cast("long").alias("sign"), F.explode(F.aggregate("steps", start, give).getField("made")).alias("x"))
    changes = given.select(F.col("x.cell").alias("c"), (F.col("x.add") * F.col("sign")).alias("change")).where("change != 0").checkpoint()
    return cells.join(_side(changes), F.col("cell") == F.col("c"), "left").withColumn("k", F.col("k") + F.coalesce("change", F.lit(0))).drop("c", "change")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents with size, source_size, target, rate, copies and taken (words taken, repeats counted)."""
    C.prepare(docs.sparkSession)
    names = docs.columns if keep is None else keep
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = docs.select(row.alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col, text_col).alias("h"), words(text_col).alias("size"))
    often = C.id_filter(rows.where("id IS NOT NULL").groupBy("id").count().where(F.col("count") > PART_ROWS).select(F.col("id").alias("hot")))
    rows = rows.join(often, F.col("id") == F.col("hot"), "left")
    # Written once, so that parts cut anywhere stay as they were counted.
    rows = rows.withColumn("h", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64(F.monotonically_increasing_id()))).checkpoint()
    cells = rows.groupBy("source", "size", "hot").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("cell", F.xxhash64("source", "size", "hot", F.isnull("source"), F.isnull("hot"))).checkpoint()
    sources = cells.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size")).checkpoint()
    prices = solve(cells, targets(sources, weights, most), most)
    planned = _copies(cells, prices, most).withColumn("parts", F.ceil(F.col("n") / PART_ROWS))
    planned = planned.select(F.col("cell"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("hot").alias("o"), "n", "k", "parts", "rate", "source_size", "target").checkpoint()
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & F.col("hot").eqNullSafe(F.col("o"))
    placed = rows.join(_side(planned), same).withColumn("part", F.pmod("h", F.col("parts")))
    ranked = bucketed_rank(placed, ["cell"], [F.col("part")], [F.col("h"), F.col("id")])
    copies = F.floor(F.col("k") / F.col("n")) + F.when(F.col("rank") <= F.col("k") % F.col("n"), 1).otherwise(0)
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names) if c not in new]
    done = ranked.withColumns({"copies": copies.cast("long"), "rate": F.col("rate").cast("double")}).withColumn("taken", F.col("copies") * F.col("size"))
    return done.select(*kept, *new)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken, without the columns of ``mix``."""
    gone = ["size", "source_size", "target", "rate", "copies", "taken"]
    times = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn("_time", times).drop("_time", *gone)
