"""Run bodies as rows: one row per item of every payload, as semi-structured values."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where providers put the item list.
_LISTS = (
    "$", "$.items", "$.data", "$.results", "$.reviews", "$.data.results", "$.results.results",
    "$.items.results", "$.providerResponse.output", "$.providerResponse.items",
    "$.providerResponse.data", "$.providerResponse.results",
)
ERROR_FIELDS = ("error", "errorDescription", "errorMessage", "errorMsg")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """SRC01. One row per file: its name and its whole body."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def run_payloads(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """SRC01. Stored run bodies with the run's columns, as ``payload_items`` reads them.

    A body's file is named by its run id (``<run_id>.json``); ``log`` is the folded run log. Files
    of unknown runs give no row.
    """
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    bodies = read_payloads(spark, path).select(F.url_decode(stem).alias("run_id"), "body")
    runs = log.filter("run_id is not null").select("local_seq", "run_id", "brand", "source")
    return bodies.join(runs, "run_id").select("local_seq", "run_id", "brand", "source", "body")


def value(item, path: str) -> Column:
    """A field as a semi-structured value, null where absent."""
    item = F.col(item) if isinstance(item, str) else item
    return F.try_variant_get(item, f"$.{path}", "variant")


def kind(item, path: str) -> Column:
    """Type name of a field: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID, OBJECT<..>."""
    return F.schema_of_variant(value(item, path))


def string(item, *paths: str) -> Column:
    """The first field that is a non-blank string, as written."""
    def one(path):
        text = F.try_variant_get(item, f"$.{path}", "string")
        return F.when((kind(item, path) == "STRING") & text.rlike(r"(?U)\S"), text)

    return F.coalesce(*[one(path) for path in paths])


def handle(item, *paths: str) -> Column:
    """The first field that is a non-blank string or an integer, stripped."""
    def one(path):
        text = F.trim(F.try_variant_get(item, f"$.{path}", "string"))
        return F.when(kind(item, path).isin("STRING", "BIGINT") & (text != ""), text)

    return F.coalesce(*[one(path) for path in paths])


def integer(item, path: str, from_text: bool = False) -> Column:
    """A whole number; optionally also one written as text with thousands commas."""
    k, text = kind(item, path), F.try_variant_get(item, f"$.{path}", "string")
    number = F.try_variant_get(item, f"$.{path}", "double")
    whole = F.when(
        (k == "BIGINT") | (k.rlike("^(DOUBLE|FLOAT|DECIMAL)") & (number == F.floor(number))),
        number.cast("long"),
    )
    if from_text:
        digits = F.replace(F.trim(text), F.lit(","), F.lit(""))
        whole = F.coalesce(whole, F.when(k == "STRING", digits.try_cast("long")))
    return whole


def iso_time(item, path: str) -> Column:
    """An ISO 8601 string as a UTC moment, to the second; no zone means UTC."""
    text = F.trim(string(item, path))
    return F.date_trunc(
        "second", F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    )


def epoch_time(item, path: str, millis: bool = False) -> Column:
    """A number as seconds since 1970; optionally as milliseconds beyond 1e11."""
    seconds = F.when(
        kind(item, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
        F.try_variant_get(item, f"$.{path}", "double"),
    )
    if millis:
        seconds = F.when(seconds > 1e11, seconds / 1000.0).otherwise(seconds)
    return F.timestamp_micros(F.floor(seconds * 1000000).cast("long"))


def is_error_item(item: str = "item") -> Column:
    """SRC13. The row reports a failed sub-fetch."""
    found = F.lit(False)
    for field in ERROR_FIELDS:
        found = found | string(item, field).isNotNull()
    return found


def payload_items(runs: DataFrame) -> DataFrame:
    """SRC01. (local_seq, run_id, brand, source, index, item) from run bodies.

    A body without an item list gives one row with a null item, so that it shows up as drift.
    """
    parsed = F.try_parse_json("body")
    output = F.try_variant_get(parsed, "$.output", "variant")
    root = F.coalesce(output, parsed)
    items = F.coalesce(
        *[F.try_variant_get(F.col("_root"), path, "array<variant>") for path in _LISTS]
    )
    return (
        runs.withColumn("_root", root)
        .withColumn("_items", items)
        .select(
            "local_seq", "run_id", "brand", "source",
            F.col("_items").isNull().alias("no_list"),
            F.posexplode_outer("_items").alias("index", "item"),
        )
        .filter(F.col("no_list") | F.col("item").isNotNull())
    )


def result_count(body: str = "body") -> Column:
    """F37. Length of the first list under output, results, items or data, one level deep."""
    parsed = F.try_parse_json(body)
    size = lambda path: F.size(F.try_variant_get(parsed, path, "array<variant>"))
    inner = ("results", "items", "data")
    paths = []
    for outer in ("output", "results", "items", "data"):
        paths += [f"$.{outer}", *[f"$.{outer}.{i}" for i in inner]]
    found = [F.when(F.try_variant_get(parsed, p, "array<variant>").isNotNull(), size(p)) for p in paths]
    return F.coalesce(*found, F.lit(0)).cast("long")
