"""One query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from earshot.llm import bpe, conversations, decontaminate, fingerprints, language, mixing, near_dedup, quality, shards, spelling, substring_dedup, token_counts, toxicity
from earshot.llm.common import crc_bucket
from earshot.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op1_near_dedup",
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
)
def op1(spark, sf_dir):
    """Components of near duplicates over all documents."""
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    """Every repeated span, with the document that keeps its text; documents without one have no row."""
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("row.doc_id", F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.keeper").alias("keeper_doc_id"), F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"), F.col("s.n_words").alias("n_words")
    )


@query(
    "op6_decontaminate",
    rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
        FROM b WHERE len(w) > 0
    ), spots AS (
        SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
    ), found AS (SELECT doc_id, i, spots.k, item_id FROM spots JOIN windows ON spots.g = windows.g AND spots.k = windows.k),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op6(spark, sf_dir):
    """Words of each document inside benchmark windows, and the items found."""
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = decontaminate.hit_words()
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op7_quality")
def op7(spark, sf_dir):
    """Posterior quality of each document from its text, its source and its source's language."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.posteriors(docs, weights, keep=["doc_id"])


@query("op10_bpe")
def op10(spark, sf_dir):
    """Ids of each whole text and the text they decode to, as digests."""
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, packed=True, keep=["doc_id"])
    back = bpe.decode(ids, vocabulary)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_fingerprints")
def op3(spark, sf_dir):
    """Fingerprints of each text and of its edit, and their likeness to each other and to the next text."""
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    """Toxicity of every document; labels of a third of the ids are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_token_counts")
def op5(spark, sf_dir):
    """Unigram tokens of every document."""
    vocabulary = token_counts.load(spark, token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])


@query("op8_language_id")
def op8(spark, sf_dir):
    """Language of every document; labels of a quarter of the ids are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


@query("op9_hilbert_shards")
def op9(spark, sf_dir):
    """Shard and place of every document along the curve."""
    placed = shards.assign(table(spark, sf_dir, "documents"), n_shards=8, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(shards.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    """Words of all documents, after planted slips, with their near words and the form that each is a variant of."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), slip=spelling.SLIP)
    return spelling.variants(words)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    """Faults of every damaged conversation, the cheapest edits that repair it, and a hash of what they leave."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.audits(rows, "conv", "turn", "role", "text", "lost").withColumnRenamed("conv", "conv_id")


@query("op13_source_mix")
def op13(spark, sf_dir):
    """Words that the mix takes of each document, by targets for each source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
