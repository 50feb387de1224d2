"""W12. A fixed-size sample, stratified in proportion."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot import config
from earshot.operators.labels import audit_draw
from earshot.operators.ranking import bucketed_rank


def allocation(rows: DataFrame, stratum: str, order: str, size: int) -> DataFrame:
    """Slots per stratum: whole shares, then one more for the largest remainders, ties by order.

    With at least ``size`` rows no share exceeds its stratum; with fewer, every row is taken.
    The windows read one row per stratum.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    shares = sizes.withColumns(
        {"_total": total, "_floor": F.floor(F.lit(size) * F.col("n") / total)}
    ).withColumn(
        # Remainder as an integer: exact, so ties are ties.
        "_rest", F.lit(size) * F.col("n") - F.col("_floor") * F.col("_total")
    )
    left = F.lit(size) - F.sum("_floor").over(every)
    turn = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), "_o"))
    slots = F.when(F.col("_total") <= size, F.col("n")).otherwise(
        F.col("_floor") + F.when(turn <= left, 1).otherwise(0)
    )
    return shares.select(stratum, "n", slots.cast("long").alias("slots"))


def stratified_sample(
    rows: DataFrame, stratum: str, order: str, size: int = config.STRATIFIED_SAMPLE,
    seed: int = config.SEED,
) -> DataFrame:
    """The rows with the lowest draws of each stratum, as many as it has slots.

    Draws are uniform, so their leading digits split a stratum of any size into even buckets.
    """
    drawn = rows.withColumn("_draw", audit_draw(seed))
    ranked = bucketed_rank(
        drawn, [stratum], [F.substring("_draw", 1, 3)], [F.col("_draw"), F.col("mention_id")], "_rank"
    )
    slots = allocation(rows, stratum, order, size).select(stratum, "slots")
    return ranked.join(slots, stratum).filter(F.col("_rank") <= F.col("slots")).drop(
        "_draw", "_rank", "slots"
    )
