"""Mentions for a table of questions: by shared words, by vectors, or by words where vectors lack.

Words are looked up in an inverted index. Mentions are dealt to blocks of about ``BLOCK_ROWS``; in a block
they are numbered by engagement and id, so the number is the order of ties. The index has one row for each
block and token, with the numbers of the mentions that have it: a token that every mention has is one list
a block, none is cut. Questions are dealt to blocks as well, and a block of questions meets a list once,
however many of its questions ask for the token. Counts of a pair of blocks are one small matrix, of which
only the best ``k`` a question go on.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot import config
from earshot.functions import text as X
from earshot.operators.vectors import cosine_top_k_many
from earshot.settings import keep

BLOCK_ROWS = 8_192
QUESTION_BLOCK = 256


class TextIndex(NamedTuple):
    """``names`` (block, pos, mention_id, engagement_score) and ``postings`` (block, token, positions)."""

    names: DataFrame
    postings: DataFrame


def _numbered(rows: DataFrame, id_col: str, size: int, order: list) -> DataFrame:
    """Adds the block of each row and its number there, from 0 on."""
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    return dealt.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1)


def text_index(mentions: DataFrame, text: str = "text", normalized: bool = False) -> TextIndex:
    """The index of a table of mentions (mention_id, engagement_score and a text), one row an id."""
    slim = keep(mentions.select("mention_id", "engagement_score", X.token_set(text, normalized).alias("tokens")))
    rows = keep(_numbered(slim, "mention_id", BLOCK_ROWS, [F.desc("engagement_score"), F.asc("mention_id")]))
    lists = rows.select("block", "pos", F.explode("tokens").alias("token")).groupBy("block", "token")
    postings = lists.agg(F.collect_list("pos").alias("positions"))  # at most a block's rows
    return TextIndex(rows.select("block", "pos", "mention_id", "engagement_score"), keep(postings))


def _best_of_blocks(k: int):
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = max(map(max, pdf["asked"])) + 1
        rows = max(map(max, pdf["positions"])) + 1
        counts = np.zeros((asked, rows), dtype=np.int64)
        for questions, positions in zip(pdf["asked"], pdf["positions"]):
            counts[np.ix_(np.asarray(questions), np.asarray(positions))] += 1
        # More words first, then the lower number: one whole number for both.
        key = np.where(counts > 0, counts * rows + (rows - 1 - np.arange(rows)), -1)
        top = np.argpartition(-key, min(k, rows) - 1, axis=1)[:, :k] if rows > k else np.tile(np.arange(rows), (asked, 1))
        q = np.repeat(np.arange(asked), top.shape[1])
        at = top.ravel()
        hit = counts[q, at] > 0
        return pd.DataFrame(
            {"qblock": pdf["qblock"].iloc[0], "qno": q[hit], "block": pdf["block"].iloc[0], "pos": at[hit], "overlap": counts[q, at][hit]}
        )

    return best


def lexical_top_k_many(
    mentions: DataFrame, questions: DataFrame, k: int = config.TOP_K, text: str = "text",
    normalized: bool = False, index: TextIndex | None = None,
) -> DataFrame:
    """V05 for a table of questions (question_id, question): (question_id, mention_id, overlap, rank).

    Most distinct tokens shared with the question, then engagement, then id; mentions that share none
    fill up to ``k``. ``index`` is the mentions' index where there is one already.
    """
    names, postings = index or text_index(mentions, text, normalized)
    asked = questions.select("question_id", X.token_set("question").alias("tokens"))
    asked = keep(_numbered(asked, "question_id", QUESTION_BLOCK, [F.asc("question_id")]).withColumnsRenamed({"block": "qblock", "pos": "qno"}))
    terms = asked.select("qblock", "qno", F.explode("tokens").alias("token")).groupBy("qblock", "token")
    wanted = terms.agg(F.collect_list("qno").alias("asked"))  # at most a block's questions
    found = postings.join(wanted, "token").groupBy("block", "qblock").applyInPandas(
        _best_of_blocks(k), "qblock int, qno int, block int, pos int, overlap int"
    )
    named = found.join(names, ["block", "pos"]).join(asked.select("qblock", "qno", "question_id"), ["qblock", "qno"])
    shared = named.select("question_id", "mention_id", "engagement_score", "overlap")
    # Of the 2k mentions with most engagement at least k share no word with a question that shares one
    # with fewer than k; a question that has k needs none.
    first = names.orderBy(F.desc("engagement_score"), F.asc("mention_id")).limit(2 * k)
    others = asked.select("question_id").crossJoin(F.broadcast(first.select("mention_id", "engagement_score")))  # 2k rows
    every = shared.unionByName(others.withColumn("overlap", F.lit(0)))
    once = every.groupBy("question_id", "mention_id", "engagement_score").agg(F.max("overlap").alias("overlap"))
    order = Window.partitionBy("question_id").orderBy(F.desc("overlap"), F.desc("engagement_score"), F.asc("mention_id"))
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("question_id", "mention_id", "overlap", "rank")


NO_QUESTION_VECTOR = "lexical fallback, the question has no vector"
NO_MENTION_VECTORS = "lexical fallback, not every mention has a vector"


def retrieve_many(
    mentions: DataFrame, questions: DataFrame, k: int = config.TOP_K, text: str = "text", normalized: bool = False,
) -> DataFrame:
    """V06 for a table of questions (question_id, question, unit): (question_id, mention_id, rank, method, note).

    Cosine where the question and every mention have a vector, else shared words, with the reason.
    """
    vectors = "unit" in mentions.columns and "unit" in questions.columns and mentions.filter("unit IS NULL").isEmpty()
    said = lambda df, method, note: df.select("question_id", "mention_id", "rank", F.lit(method).alias("method"), F.lit(note).cast("string").alias("note"))
    if not vectors:
        return said(lexical_top_k_many(mentions, questions, k, text, normalized), "lexical", NO_MENTION_VECTORS)
    near = cosine_top_k_many(mentions, questions.filter("unit IS NOT NULL"), k)
    words = lexical_top_k_many(mentions, questions.filter("unit IS NULL"), k, text, normalized)
    return said(near, "cosine", None).unionByName(said(words, "lexical", NO_QUESTION_VECTOR))
