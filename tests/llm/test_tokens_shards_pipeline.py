import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from earshot.llm import bpe, decontaminate, near_dedup, shards, token_counts


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
    return t


def test_counts_match_the_tokenizer():
    pieces = token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    lib, counter, rng = library(pieces), token_counts.Counter(pieces), random.Random(1)
    cases = ["", "a", " ", "  ", "\n", " a", "▁a", "a▁b", "\U0001f600\U0001f600 x", "漢字 字"]
    cases += ["".join(rng.choice("abcdeth   \n▁é字\U0001f600\U0001f9ffx.") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert [counter.count(t) for t in cases] == [len(lib.encode(t).ids) for t in cases]


def test_ties_match_the_tokenizer():
    rng = random.Random(2)
    for _ in range(120):
        words = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0), *[(w, -float(rng.randint(1, 3))) for w in sorted(words)]]
        lib, counter = library(pieces), token_counts.Counter(pieces)
        for _ in range(20):
            text = "".join(rng.choice("abcd  ") for _ in range(rng.randint(0, 14)))
            assert counter.count(text) == len(lib.encode(text).ids)


def test_token_count_rows(spark, odd_docs):
    docs = odd_docs()
    vocabulary = token_counts.load(spark, token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
    out = token_counts.token_counts(docs, vocabulary).collect()
    assert len(out) == docs.count() and all((r.n_tokens == 0) == (not r.text) for r in out)
    assert token_counts.token_counts(docs.limit(0), vocabulary).count() == 0
    assert token_counts.Counter([("<unk>", 0.0)]).count("ab c") == 2


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    index = shards.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def checked(placed, docs, n):
    rows = placed.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards_are_even_and_keep_copies_together(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for per_bin in (50_000, 300):
        monkeypatch.setattr(shards, "GROUPS_PER_BIN", per_bin)
        rows, sizes = checked(shards.assign(docs), docs, 8)
        assert max(sizes.values()) / min(sizes.values()) < 1.02
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    homes = {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    spread = shards.assign(docs).groupBy("shard").agg(F.countDistinct("lang").alias("k")).agg(F.avg("k")).first()[0]
    assert spread < 4  # a shard does not hold every language


def test_a_group_larger_than_a_shard_is_split(spark, prose):
    rows = [(i, "same text here", "en", "s") for i in range(400)] + [(1000 + i, prose(i, 3), "en", "s") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    _, sizes = checked(shards.assign(docs), docs, 8)
    assert max(sizes.values()) / min(sizes.values()) < 1.1


def test_shards_odd_rows(spark, odd_docs, folder):
    docs = odd_docs()
    checked(shards.assign(docs), docs, 8)
    assert shards.assign(docs.limit(0)).count() == 0
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards.write_shards(small, f"{folder}/out", n_shards=4)
    assert spark.read.parquet(f"{folder}/out").count() == small.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        seen[name] = out
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality classifier"].collect()}
    known = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert np.mean(known) > 0.97
    # No two near copies are left, and no window of an item.
    near = near_dedup.near_components(seen["near duplicates"])
    assert near.where("NOT kept").count() == 0
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.find_hits(seen["benchmark decontamination"], bench).where(decontaminate.hit_words() > 0).count() == 0
    # The ids are those of the texts of the stage before.
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in seen["benchmark decontamination"].collect()}
    back = bpe.decode(seen["bpe encoding"], vocabulary).collect()
    assert {r.doc_id: r.decoded for r in back} == texts
    assert P.run(spark, sf_dir).count() == len(texts)
