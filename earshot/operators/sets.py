"""Ordered unions of small report tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import config

_ABSTENTION = ("scope", "brand", "source", "reason", "detail")


def _numbered(groups: Sequence[DataFrame], columns: Sequence[str], position: str) -> DataFrame:
    out = None
    for at, group in enumerate(groups):
        part = group.select(
            *columns, F.struct(F.lit(at).alias("g"), F.col(position).cast("long").alias("p")).alias("at")
        )
        out = part if out is None else out.unionByName(part)
    return out


def merge_abstentions(*groups: DataFrame, position: str = "position") -> DataFrame:
    """U02. Distinct on the five fields; earlier groups first, then each group's own order."""
    every = _numbered(groups, _ABSTENTION, position)
    return every.groupBy(*_ABSTENTION).agg(F.min("at").alias("at"))


def coverage_gaps(gaps: DataFrame, skipped: DataFrame) -> DataFrame:
    """U03. Gaps and skipped sources, and the constant row for x where nobody stated it."""
    spark = gaps.sparkSession
    both = gaps.select("source", "reason", "note").unionByName(skipped.select("source", "reason", "note"))
    x = spark.createDataFrame([config.X_GAP], "source string, reason string, note string")
    stated = both.filter("source = 'x' and reason = 'unavailable'").select("source", "reason")
    return both.unionByName(x.join(stated, ["source", "reason"], "left_anti").select("source", "reason", "note"))


def distinct_notes(notes: DataFrame) -> DataFrame:
    """U04. Each note once, at its first place, the note on x before all others."""
    spark = notes.sparkSession
    x = spark.createDataFrame([(config.X_NOTE, 0)], "note string, position long")
    every = _numbered([x, notes], ["note"], "position")
    return every.groupBy("note").agg(F.min("at").alias("at"))
