"""Stored tables: JSON lines at the edge, partitioned Parquet inside."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import schemas
from earshot.functions import text as X
from earshot.functions.word_lists import sentiment_terms
from earshot.operators.ranking import keep_last
from earshot.settings import checkpoint_dir


_BATCH = "batch bigint, batch_line bigint"
#: Lines of a part file, at most: a compressed file is read by one task.
LINES_PER_FILE = 500_000


def _line_order(df: DataFrame) -> DataFrame:
    """``write_seq`` of JSON lines: the batch and line that the writer put into them.

    Part files of an append have random names, so their order says nothing; writers number their
    batches. Lines without a number are older than all batches and follow file, block and position; numbered
    lines carry no file name, which would be most of what an exchange of them sends.
    """
    unnumbered = F.col("batch").isNull()
    return df.withColumn(
        "write_seq",
        F.struct(
            F.coalesce("batch", F.lit(-1)).cast("long").alias("batch"),
            F.coalesce("batch_line", F.lit(-1)).cast("long").alias("batch_line"),
            F.when(unnumbered, F.col("_metadata.file_path")).alias("file"),
            F.when(unnumbered, F.col("_metadata.file_block_start")).alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ),
    ).drop("batch", "batch_line")


def _append(df: DataFrame, path: str, batch: int) -> None:
    """Numbered lines, compressed: field names are most of a line."""
    if batch < 0:
        raise ValueError("batches are numbered from 0 on")
    lines = df.withColumns({"batch": F.lit(batch).cast("long"), "batch_line": F.monotonically_increasing_id()})
    lines.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).json(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which every executor can reach."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """SRC14."""
    return spark.read.schema(schemas.MENTION).json(path)


def write_table(df: DataFrame, path: str, session_id: str) -> None:
    """SRC14, SRC17. Parquet partitioned by session; a rerun replaces its own session only."""
    df.withColumn("session_id", F.lit(session_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("session_id").parquet(path)


def read_table(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if session_id is None else df.filter(F.col("session_id") == session_id)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC15. ``{brand, label}`` lines, the last line per mention and brand."""
    schema = f"brand string, label struct<{_nested(schemas.LABEL)}>, {_BATCH}"
    lines = spark.read.schema(schema).json(path)
    flat = _line_order(lines.select("*", "_metadata")).select("brand", "write_seq", "label.*")
    return keep_last(flat, ["mention_id", "brand"], ["write_seq"], with_order=False)


def _nested(schema: str) -> str:
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def write_labels(labels: DataFrame, path: str, batch: int) -> None:
    """SRC15. Append JSON lines of ``{brand, label}``; lines of a higher batch win."""
    names = [c for c in schemas.columns(schemas.LABEL) if c in labels.columns]
    lines = labels.select("brand", F.struct(*names).alias("label"))
    _append(lines, path, batch)


def write_log(log: DataFrame, path: str, batch: int) -> None:
    """SRC16. Append lines of the run log; lines of a higher batch are later."""
    names = [c for c in schemas.columns(schemas.RUN) if c in log.columns]
    _append(log.select(*names), path, batch)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC16. All lines of the append-only run log, with their order."""
    lines = spark.read.schema(f"{schemas.RUN}, {_BATCH}").json(path)
    return _line_order(lines.select("*", "_metadata")).drop("_metadata")


def one_object(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC17. Small result tables (a few rows per brand) as one JSON object per table."""
    out = None
    for name, table in tables.items():
        rows = table.agg(
            F.to_json(F.sort_array(F.collect_list(F.to_json(F.struct("*"))))).alias("json")
        ).select(F.lit(name).alias("table"), "json")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """SRC18. ``polarity<TAB>term`` lines; comments and blanks skipped, terms normalised."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    parts = F.split(F.trim("value"), "\t", 2)
    return lines.select(
        F.when(parts[0] == "+", 1)
        .when(parts[0] == "-", -1)
        .otherwise(F.raise_error(F.concat(F.lit("bad lexicon line: "), "value")).cast("int"))
        .alias("polarity"),
        X.normalize(F.get(parts, F.lit(1))).alias("term"),
    )


def lexicon_conflicts(lexicon: DataFrame) -> DataFrame:
    """SRC18. Terms listed with both polarities; a usable lexicon has none."""
    return lexicon.groupBy("term").agg(F.countDistinct("polarity").alias("n")).filter("n > 1")


def default_lexicon(spark: SparkSession) -> DataFrame:
    rows = sorted(sentiment_terms().items())
    return spark.createDataFrame([(p, t) for t, p in rows], "polarity int, term string")
