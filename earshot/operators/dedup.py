"""W03. One mention per (source, brand) and identity rule; the dropped ones say why."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as X

KEYS = ("source", "brand", "dedup_rule", "dedup_key")
_LOW = 1 << 31


def with_position(items: DataFrame) -> DataFrame:
    """``raw_ref`` ("run#item") as one number that sorts by run, then item."""
    parts = F.split("raw_ref", "#")
    position = parts[0].cast("long") * F.lit(_LOW) + parts[1].cast("long")
    return items.withColumn("position", position)


def identity(items: DataFrame) -> DataFrame:
    """The rule that applies to a row and its key: native id, else normalised url, else text."""
    rule = (
        F.when(F.col("native_id").isNotNull(), "dedup_native_id")
        .when(F.col("url").isNotNull(), "dedup_url")
        .otherwise("dedup_text")
    )
    # The text is shipped to the folding function only where the text rule applies.
    plain = F.when(F.col("native_id").isNull() & F.col("url").isNull(), F.col("text"))
    key = F.coalesce("native_id", X.normalize_url("url"), X.text_key(plain))
    return items.withColumns({"dedup_rule": rule, "dedup_key": key})


def winners(keyed: DataFrame) -> DataFrame:
    """Lowest position per key, as a map-side combined minimum over one number."""
    return keyed.groupBy(*KEYS).agg(F.min("position").alias("winner"))


def dedup(items: DataFrame) -> DataFrame:
    """All rows with ``reason`` (null where kept) and the winner's ``winner_ref``.

    The lowest run, then item, wins. The join is on a hash of the key, so the winners get an
    exchange of their own and the adaptive planner can split a key that many rows share.
    """
    keyed = identity(with_position(items))
    hashed = F.xxhash64(*KEYS)
    won = winners(keyed).select(*[F.col(c).alias(f"_{c}") for c in KEYS], "winner", hashed.alias("_hash"))
    same = [F.col(c) == F.col(f"_{c}") for c in KEYS]
    joined = keyed.withColumn("_key_hash", hashed).join(won, reduce(and_, same, F.col("_key_hash") == F.col("_hash")))
    joined = joined.drop("_hash", "_key_hash", *[f"_{c}" for c in KEYS])
    dropped = F.col("position") != F.col("winner")
    winner_ref = F.concat(
        F.floor(F.col("winner") / _LOW).cast("string"),
        F.lit("#"),
        (F.col("winner") % _LOW).cast("string"),
    )
    return joined.withColumns(
        {"reason": F.when(dropped, F.col("dedup_rule")), "winner_ref": winner_ref}
    ).drop("dedup_key", "dedup_rule", "winner", "position")


def kept(deduped: DataFrame) -> DataFrame:
    return deduped.filter("reason is null").drop("reason", "winner_ref")


def dropped(deduped: DataFrame) -> DataFrame:
    return deduped.filter("reason is not null")


def repeated_keys(mentions: DataFrame) -> DataFrame:
    """Q07. (mention_id, brand) pairs that occur more than once."""
    return (
        mentions.groupBy("mention_id", "brand")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
