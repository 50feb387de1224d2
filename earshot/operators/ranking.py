"""Exact ranks, running totals and winners that never put one whole group into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _name_buckets(df: DataFrame, bucket: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_bucket{i}" for i in range(len(bucket))]
    return df.withColumns(dict(zip(names, bucket))), names


def _offsets(df: DataFrame, group: Sequence[str], names: Sequence[str], measure: Column):
    """Per bucket: the sum of ``measure`` over every earlier bucket of the group.

    The window reads one row per bucket, so its size follows the bucket count, not the rows.
    """
    per_bucket = df.groupBy(*group, *names).agg(measure.alias("_sum"))
    earlier = (
        Window.partitionBy(*group)
        .orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_bucket.select(
        *group, *names, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )


BUCKETS = 256
SAMPLE = 20_000


def range_bucket(df: DataFrame, column: str) -> Column:
    """A bucket number that agrees with the order of a text column and cuts it evenly.

    The cuts come from the values with the least hashes, ``SAMPLE`` at most, so they are the same
    for the same rows and fit keys with any common prefix. Ranks do not depend on the cuts.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    taken = sorted(r[0] for r in values.orderBy(F.xxhash64(column), column).limit(SAMPLE).collect())
    cuts = sorted({taken[i * len(taken) // BUCKETS] for i in range(1, BUCKETS)} if taken else set())
    if not cuts:
        return F.lit(0)
    wide = 16
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    count = lambda values: F.size(F.filter(values, lambda c: c <= F.col(column)))
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    coarse = count(texts([g[-1] for g in groups]))
    fine = F.when(coarse < len(groups), count(F.get(F.array(*[texts(g) for g in groups]), coarse))).otherwise(0)
    return F.coalesce(coarse * wide + fine, F.lit(-1))


def bucketed_rank(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    out: str = "rank",
) -> DataFrame:
    """``row_number`` of ``order`` within ``group``, for groups of any size.

    ``bucket`` lists non-null columns that agree with ``order``: a row of a lower bucket never
    ranks after one of a higher bucket. Rows are counted per bucket, the counts are summed up
    along the buckets, and only the rows of one bucket are sorted together.
    """
    named, names = _name_buckets(df, bucket)
    offsets = _offsets(named, group, names, F.count(F.lit(1)))
    within = Window.partitionBy(*group, *names).orderBy(*order)
    return (
        named.join(offsets, [*group, *names])
        .withColumn(out, F.row_number().over(within) + F.col("_offset"))
        .drop(*names, "_offset")
    )


def bucketed_running_total(
    df: DataFrame,
    bucket: Sequence[Column],
    order: Sequence[Column],
    value: str,
    out: str,
) -> DataFrame:
    """Sum of ``value`` over all rows before this one in ``order``, over the whole table."""
    named, names = _name_buckets(df, bucket)
    offsets = _offsets(named, [], names, F.sum(value))
    within = (
        Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        named.join(offsets, names)
        .withColumn(
            out, F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("_offset")
        )
        .drop(*names, "_offset")
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group.

    The rank filter is pushed below the exchange (each input partition sends at most ``k`` rows
    a group), so a group that holds most rows costs no more than any other.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], with_order: bool = True) -> DataFrame:
    """W01/W02. The row with the greatest ``order`` per key; combined before the exchange.

    Without ``with_order`` the result lacks the order's columns, which are then exchanged once a row, not twice.
    """
    return _keep(df, keys, order, F.max_by, with_order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W01. The row with the smallest ``order`` per key; combined before the exchange."""
    return _keep(df, keys, order, F.min_by)


def _keep(df, keys, order, pick, with_order=True):
    rest = [c for c in df.columns if c not in keys and (with_order or c not in order)]
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
