"""The two incremental jobs: ledger state, and deduplicated daily counts with spike days.

The ledger's current rows live in the stream's state store, keyed by ``local_seq``, and are read from
there as a table; batches hold only what changed. Mentions are deduplicated by a table of identities that
holds the lowest reference of each until the watermark passes its last date; the winners are counted by
day. Every batch writes under its own batch number and overwrites only that, so a batch that is
run again after a failure leaves the same table.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.dedup import KEYS, identity, with_position
from earshot.operators.events import baselines
from earshot.operators.ranking import keep_last


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def start_ledger_stream(
    log: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """S01. Append-only log lines -> changed rows per batch; the last line of each ``local_seq`` stays in state.

    Late and repeated lines change nothing. ``path`` also names the checkpoint, for ``ledger_state``.
    """
    spark = log.sparkSession
    spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_state_of")
    writer = (
        keep_last(log, ["local_seq"], ["write_seq"])
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: _write_batch(batch, path, number))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ledger_state(spark: SparkSession, path: str) -> DataFrame:
    """S01. The current row per ``local_seq``, read from the stream's state; no batch is read again.

    A folder that ``compact_ledger`` has written holds the rows themselves.
    """
    source = _state_of(spark, path)
    if source is None:
        return spark.read.parquet(path).drop("batch")
    state = spark.read.format("statestore").load(source)
    # What the state keeps of a key: the row with the greatest order so far, then the order.
    row = state.schema["value"].dataType.fieldNames()[0]
    return state.select("key.local_seq", f"value.{row}.*")


def _state_of(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(f"{path}/_state_of").first()[0]
    except AnalysisException:
        return None


def compact_ledger(spark: SparkSession, path: str, target: str) -> None:
    """S01. The state as one batch in a new place, to start from."""
    _write_batch(ledger_state(spark, path), target, 0)


#: What is kept of an identity, and of an open day. Times are microseconds.
_HELD = "source string, brand string, dedup_rule string, dedup_key string, low struct<position:long,at:long,cluster_key:string>, last long, done boolean"
_OPEN = "day date, brand string, cluster_key string, n long"
_MARKS = "seen long, settled long, won long"


def _hold(batch: DataFrame, held: DataFrame, settled: int | None) -> DataFrame:
    """S02. ``held`` with the rows of a batch: the lowest reference and the last date of each identity.

    Rows behind ``settled`` are late.
    """
    at = F.unix_micros("published_at")
    in_time = F.lit(True) if settled is None else at > settled
    rows = identity(with_position(batch.filter(F.col("published_at").isNotNull() & in_time)))
    fresh = rows.select(
        *KEYS, F.struct("position", at.alias("at"), "cluster_key").alias("low"), at.alias("last"), F.lit(False).alias("done")
    )
    # Identities of the state and of the batch are a row each for one and the same aggregate.
    every = fresh.unionByName(held)
    return every.groupBy(*KEYS).agg(F.min("low").alias("low"), F.max("last").alias("last"), F.bool_or("done").alias("done"))


def undated(mentions: DataFrame) -> DataFrame:
    """S02. Rows without a date go beside the stream: no window can hold them."""
    return mentions.filter("published_at is null")


def _count(winners: DataFrame, counted: DataFrame, closed: int | None) -> DataFrame:
    """S02. Winners of each cluster by brand and UTC day, added to those of the open days."""
    at = F.timestamp_micros("low.at")
    fresh = winners.select(F.to_date(at).alias("day"), "brand", F.col("low.cluster_key").alias("cluster_key"), F.lit(1).cast("long").alias("n"))
    fresh = fresh.filter(~_ends_by(closed))
    return fresh.unionByName(counted).groupBy("day", "brand", "cluster_key").agg(F.sum("n").alias("n"))


def _ends_by(mark: int | None):
    """The column ``day`` is over at the mark."""
    if mark is None:
        return F.lit(False)
    return F.unix_micros(F.date_add("day", 1).cast("timestamp")) <= mark


def start_daily_stream(
    mentions: DataFrame,
    path: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    delay: str = "2 days",
    memory: str = "2 days",
) -> StreamingQuery:
    """S02. Writes each batch of closed days; ``on_batch`` may act on them (spikes, alerts).

    Dated mentions count once for each identity, as the one with the lowest reference (``raw_ref``). An
    identity waits until the watermark, ``delay`` behind the newest date, has passed the last date among its
    copies, and is remembered for ``memory`` more, so that a later copy is no new winner. Copies within these
    bounds may arrive in any order. A day is closed by the first winner after it; it has its winners and
    their distinct clusters.

    Identities and open days are tables at ``<checkpoint>-state``, which a batch joins by one aggregate each.
    Two places take turns: batch n reads what n - 1 left and overwrites what n - 2 left, so a batch that is
    run again starts from the same state.
    """
    wait, hold = (int(pd.Timedelta(t) / pd.Timedelta(microseconds=1)) for t in (delay, memory))

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = lambda n, name: f"{checkpoint}-state/{n % 2}/{name}"

        def left(name: str, schema: str) -> DataFrame:
            if number == 0:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(place(number - 1, name))

        def put(df: DataFrame, name: str, schema: str) -> DataFrame:
            df.write.mode("overwrite").parquet(place(number, name))
            return spark.read.schema(schema).parquet(place(number, name))

        seen, settled, won = left("marks", _MARKS).first() or (None, None, None)
        past = F.col("last") <= F.lit(settled)
        known = left("held", _HELD).withColumn("done", F.col("done") | F.coalesce(past, F.lit(False)))
        kept = known.filter(~F.col("done") | (F.col("last") + hold > F.lit(settled)))
        held = put(_hold(batch, kept, settled), "held", _HELD)
        newest = held.agg(F.max("last")).first()[0]
        seen = max((m for m in (seen, newest) if m is not None), default=None)
        settled = None if seen is None else seen - wait
        winners = held.filter(~F.col("done") & (F.col("last") <= F.lit(settled)))
        counted = put(_count(winners, left("open", _OPEN).filter(~_ends_by(won)), won), "open", _OPEN)
        newest = winners.agg(F.max("low.at")).first()[0]
        won = max((m for m in (won, newest) if m is not None), default=None)
        spark.createDataFrame([(seen, settled, won)], _MARKS).coalesce(1).write.mode("overwrite").parquet(place(number, "marks"))
        days = counted.filter(_ends_by(won)).groupBy("day", "brand").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
        _write_batch(days, path, number)
        if on_batch is not None:
            on_batch(spark.read.parquet(f"{path}/batch={number}"), number)

    writer = mentions.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def closed_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day date, brand string, n long, n_clusters long").parquet(path + "/*")


def stream_spikes(days: DataFrame) -> DataFrame:
    """S02. The spike rule over the last 14 closed days of each brand (missing days are zero)."""
    last = days.groupBy("brand").agg(F.max("day").alias("last"))
    calendar = last.select(
        "brand", F.explode(F.sequence(F.date_sub("last", 13), F.col("last"))).alias("day")
    )
    filled = calendar.join(days, ["brand", "day"], "left").fillna(0, subset=["n", "n_clusters"])
    based = baselines(filled)
    return based.filter((F.col("n") >= F.col("threshold")) & (F.col("n_clusters") >= 3) & (F.col("n") > 0))


__all__ = [
    "closed_days", "compact_ledger", "ledger_state", "start_daily_stream", "start_ledger_stream", "stream_spikes", "undated",
]
