"""Questions over stored mentions: candidates, ranking, and checks on what an answer claims."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import numbers as N
from earshot.functions import text as X
from earshot.operators.frame import relevant_for_stats
from earshot.operators.ranking import keep_first
from earshot.operators.vectors import cosine_top_k
from earshot.settings import keep, store


def brand_rows(labelled: DataFrame, brand: str) -> DataFrame:
    """V07. Relevant rows of a brand, whatever its case, one per mention id."""
    wanted = X.normalize_literal(brand)
    rows = labelled.filter(relevant_for_stats()).filter(X.normalize_term("brand") == wanted)
    return keep_first(rows, ["mention_id"], ["raw_ref"])


def lexical_top_k(
    mentions: DataFrame, question: str, k: int = config.TOP_K, text: str = "text",
    normalized: bool = False,
) -> DataFrame:
    """V05. Most distinct tokens shared with the question, then engagement, then id."""
    tokens = [t for t in X.normalize_literal(question).split() if len(t) >= config.MIN_TOKEN_CHARS]
    asked = F.array(*[F.lit(t) for t in sorted(set(tokens))]).cast("array<string>")
    shared = F.size(F.array_intersect(X.token_set(text, normalized), asked))
    return (
        mentions.withColumn("overlap", shared)
        .orderBy(F.desc("overlap"), F.desc("engagement_score"), F.asc("mention_id"))
        .limit(k)
    )


def retrieve(
    mentions: DataFrame, question: str, question_vector=None, k: int = config.TOP_K
) -> tuple[DataFrame, str]:
    """V06. (top k, method). Cosine when the question and every mention has a vector."""
    lacking = question_vector is None or "unit" not in mentions.columns
    if lacking or not mentions.filter("unit is null").isEmpty():
        return lexical_top_k(mentions, question, k), "lexical"
    return cosine_top_k(mentions, question_vector, k), "cosine"


# -- citations ------------------------------------------------------------------------------------
def citation_checks(answers: DataFrame, known: DataFrame) -> DataFrame:
    """J13. One row per distinct citation: answer_id, position, cited, and whether it is known.

    ``answers`` has (answer_id, citations array), ``known`` mention ids, one row each or more.
    """
    cited = (
        answers.select("answer_id", F.posexplode("citations").alias("position", "raw"))
        .withColumn("cited", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
        .filter("cited <> ''")
        .groupBy("answer_id", "cited")
        .agg(F.min("position").alias("position"))
    )
    # The join is on a hash, so the known side has an exchange of its own and a citation that all
    # answers share can be split.
    have = known.select(F.col("mention_id").alias("_k")).distinct().withColumn("_have", F.xxhash64("_k"))
    found = cited.withColumn("_hash", F.xxhash64("cited")).join(
        have, (F.col("_hash") == F.col("_have")) & (F.col("cited") == F.col("_k")), "left"
    )
    return found.select(
        "answer_id", "position", "cited", F.col("_k").isNotNull().alias("known")
    )


# -- numbers --------------------------------------------------------------------------------------
#: Fields whose digits are ids or addresses, at any depth of a record (fixed values).
ID_FIELDS = (
    "mention_id", "exemplar_mention_ids", "topic_id", "url", "native_id", "raw_ref", "cluster_key",
    "author_hash", "run_id", "exhibit_url",
)
#: Types of a variant's leaf that are numbers.
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def available_from_columns(table: DataFrame, columns) -> DataFrame:
    """V08. Distinct values of numeric columns, in plain form."""
    values = F.array(*[N.number_text(F.col(c)) for c in columns])
    return table.select(F.explode(values).alias("value")).filter("value is not null").distinct()


def _written(text) -> Column:
    """Values of the numbers written in a text, without dates."""
    found = N.extract_numbers(F.regexp_replace(F.coalesce(text, F.lit("")), N._ISO, " "))
    return F.transform(found, lambda token: token["value"])


def available_from_texts(table: DataFrame, columns) -> DataFrame:
    """V08. Distinct numbers written in text columns; give no id, link or hash columns."""
    values = F.flatten(F.array(*[_written(F.col(c)) for c in columns]))
    return table.select(F.explode(values).alias("value")).filter("value is not null").distinct()


def record_leaves(records: DataFrame, scope=()) -> DataFrame:
    """Leaves of nested records as rows: the ``scope`` columns, path, key (the nearest field name) and value (variant).

    Structs, maps, arrays and variants are walked to any depth, one level of all records at a time; each
    level is written once. The number of steps is the depth of the deepest record.
    """
    scope = list(scope)
    fields = [c for c in records.columns if c not in scope]
    whole = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in fields]))
    level = records.select(*scope, F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), whole.alias("value"))
    leaves = None
    while True:
        inside = level.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("value").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = F.coalesce(F.concat(F.lit("."), "_key"), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        named = inside.select(*scope, F.concat("path", step).alias("path"), F.coalesce("_key", "key").alias("key"), F.col("_value").alias("value"))
        level = keep(named.withColumn("_nested", F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")))
        found = level.filter("NOT _nested").drop("_nested")
        leaves = found if leaves is None else leaves.unionByName(found)
        level = level.filter("_nested").drop("_nested")
        if level.isEmpty():
            return leaves


def available_from_records(records: DataFrame, scope=(), id_fields=ID_FIELDS) -> DataFrame:
    """V08. Distinct values of a table of nested records, per ``scope``: numeric leaves, and numbers written
    in text leaves but for id fields. No column list is needed; booleans and times are no numbers.
    """
    leaves = record_leaves(records, scope)
    kind, text = F.schema_of_variant("value"), F.variant_get("value", "$", "string")
    none = F.array().cast("array<string>")
    values = F.when(kind.rlike(_NUMERIC), F.array(N.number_text(text))).when(
        (kind == "STRING") & ~F.coalesce(F.col("key").isin(*id_fields), F.lit(False)), _written(text)
    ).otherwise(none)
    return leaves.select(*scope, F.explode(values).alias("value")).filter("value is not null").distinct()


def number_checks(
    answers: DataFrame, available: DataFrame, scope=(), text: str = "answer", spoken: bool = False
) -> DataFrame:
    """J14. One row per distinct number text of an answer, and whether it is backed.

    A number passes when an available value equals it (a percentage also as a proportion), or, if
    it is written with decimals or as a percentage, when an available value rounds to it. Values are in
    plain form, of any length; each is known as it is, and rounded to the places that any answer asks
    for, where that is fewer than it has. A number and what is known meet once, by an equi-join on the
    value. ``available`` has ``value`` (a number or its text) and the ``scope`` columns both sides share;
    an answer lies in one scope.
    """
    scope = list(scope)
    source = F.col(text) if spoken else N.clean_for_numbers(text)
    tokens = answers.select(
        "answer_id", *scope, F.posexplode(N.extract_numbers(source, spoken)).alias("position", "token")
    ).select("answer_id", *scope, "position", "token.*")
    # Numbers are read from the texts once; as files they take a small part of a checkpoint.
    tokens = store(tokens)
    # What a number may equal, and the places to which a known value may be rounded for it.
    token = F.struct("value", "percent", "decimals")
    options = tokens.select(
        "answer_id", "position", F.col("text").alias("number"), *scope, F.explode(N.match_forms(token)).alias("o")
    ).select("answer_id", "position", "number", *scope, "o.value", "o.places")
    # Places that anybody wrote: as many as the longest number has digits, at most.
    asked = tokens.select(F.inline(N.match_forms(token))).agg(F.collect_set("places").alias("_all"))  # one row
    # A value without a number is null and meets nothing. Each value is rounded once, inside the array.
    values = available.select(*scope, N.number_text("value").alias("value"))
    form = lambda v, p: F.struct(v.alias("value"), p.cast("int").alias("at"))
    fewer = F.filter("_all", lambda p: p < N.places_of(F.col("value")))
    cut = F.transform(fewer, lambda p: form(N.rounded(F.col("value"), p), p))
    forms = F.concat(F.array(form(F.col("value"), F.lit(None))), cut)
    known = values.crossJoin(F.broadcast(asked)).select(*scope, F.inline(forms))
    # What equals a written number also rounds to it.
    met = known.groupBy(*scope, "value").agg(F.bool_or(F.col("at").isNull()).alias("_equal"), F.collect_set("at").alias("_at"))
    joined = options.join(met, [*scope, "value"], "left")
    ok = F.coalesce(F.col("_equal") | F.array_contains("_at", F.col("places")), F.lit(False))
    return joined.groupBy("answer_id", "number").agg(
        F.min("position").alias("position"), F.bool_or(ok).alias("verified")
    ).select("answer_id", "position", "number", "verified")


def check_answers(
    answers: DataFrame, known: DataFrame, available: DataFrame, scope=()
) -> DataFrame:
    """V09. Status per answer, with what failed and the text without unknown citations.

    An answer cites and states a bounded number of things; only those are collected per answer.
    """
    cites = citation_checks(answers, known)
    numbers = number_checks(answers, available, scope)

    def listed(table, keep, value):
        ordered = F.array_sort(F.collect_list(F.when(keep, F.struct("position", value))))
        return F.transform(ordered, lambda row: row[value])

    by_cite = cites.groupBy("answer_id").agg(
        listed(cites, F.col("known"), "cited").alias("citations_kept"),
        listed(cites, ~F.col("known"), "cited").alias("citations_unknown"),
    )
    by_number = numbers.groupBy("answer_id").agg(
        listed(numbers, F.col("verified"), "number").alias("verified_numbers"),
        listed(numbers, ~F.col("verified"), "number").alias("foreign_numbers"),
    )
    names = ["citations_kept", "citations_unknown", "verified_numbers", "foreign_numbers"]
    empty = F.array().cast("array<string>")
    joined = answers.join(by_cite, "answer_id", "left").join(by_number, "answer_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, empty) for c in names})
    failed = (F.size("citations_unknown") > 0) | (F.size("foreign_numbers") > 0)
    return filled.withColumns(
        {
            "answer": N.strip_citations("answer", "citations_unknown"),
            "status": F.when(failed, "unverified").otherwise("ok"),
        }
    )


def narration_checks(narrations: DataFrame, available: DataFrame, scope=()) -> DataFrame:
    """V10. Whether every number of a narration occurs in the digest's numbers."""
    numbers = number_checks(narrations, available, scope, "narration", spoken=True)
    verdict = numbers.groupBy("answer_id").agg(
        F.bool_and("verified").alias("_all"), F.count_if(~F.col("verified")).alias("_foreign")
    )
    return narrations.join(verdict, "answer_id", "left").select(
        *narrations.columns,
        F.coalesce("_all", F.lit(True)).alias("numbers_verified"),
        F.coalesce("_foreign", F.lit(0)).alias("n_foreign"),
    )
