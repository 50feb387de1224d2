import random

import numpy as np
from pyspark.sql import functions as F

from earshot.operators import retrieval as R
from earshot.operators import vectors as V


def brute(mentions, questions, k):
    out = {}
    for q, text in questions:
        asked = {t for t in (text or "").lower().split() if len(t) >= 3}
        scored = [(-len(asked & {t for t in (m[1] or "").lower().split() if len(t) >= 3}), -m[2], m[0]) for m in mentions]
        out[q] = [(i, -o) for o, _, i in sorted(scored)[:k]]
    return out


def table(seed=3, n=160, questions=37):
    rng = random.Random(seed)
    words = ["the"] * 30 + [f"word{i}" for i in range(60)] + ["an", "of"]
    mentions = [(f"m{i:04d}", rng.choice([None, "the"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))), rng.randrange(5)) for i in range(n)]
    asked = [(f"q{i}", " ".join(rng.choice(words + ["rare"]) for _ in range(rng.randrange(0, 12)))) for i in range(questions)]
    return mentions, asked + [("none", "an of"), ("null", None), ("once", "word7")]


def ranked(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r["question_id"], []).append((r["mention_id"], r["overlap"]))
    return out


def test_words_for_many_questions_equal_brute_force(spark, monkeypatch):
    mentions, asked = table()
    m = spark.createDataFrame(mentions, "mention_id string, text string, engagement_score long").repartition(3)
    q = spark.createDataFrame(asked, "question_id string, question string")
    want = brute(mentions, asked, 9)
    assert ranked(R.lexical_top_k_many(m, q, 9)) == want
    # Many blocks of either side; an index made before.
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 4)
    index = R.text_index(m)
    assert index.postings.agg(F.max(F.size("positions"))).first()[0] < 40
    assert ranked(R.lexical_top_k_many(m, q, 9, index=index)) == want


def test_fallback_is_chosen_for_each_question(spark):
    mentions, asked = table(5, 60, 6)
    rng = np.random.default_rng(2)
    points = {m[0]: rng.normal(size=5) for m in mentions}
    rows = [(i, t, e, [float(x) for x in points[i] / np.linalg.norm(points[i])]) for i, t, e in mentions]
    schema = "mention_id string, text string, engagement_score long, unit array<double>"
    m = spark.createDataFrame(rows, schema)
    has = {q: rng.normal(size=5) for q, _ in asked[::2]}
    q = spark.createDataFrame([(i, t, [float(x) for x in has[i]] if i in has else None) for i, t in asked], "question_id string, question string, unit array<double>")
    got = {}
    for r in R.retrieve_many(m, q, 4).orderBy("rank").collect():
        got.setdefault((r["question_id"], r["method"], r["note"]), []).append(r["mention_id"])
    words = brute(mentions, asked, 4)
    assert len(got) == len(asked)
    for (question, method, note), found in got.items():
        if question in has:
            score = {r[0]: float(np.dot(r[3], has[question])) for r in rows}
            assert (method, note) == ("cosine", None) and found == sorted(score, key=lambda i: -score[i])[:4]
        else:
            assert (method, note) == ("lexical", R.NO_QUESTION_VECTOR) and found == [i for i, _ in words[question]]
    some = m.withColumn("unit", F.when(F.col("mention_id") > "m0001", F.col("unit")))
    assert {(r["method"], r["note"]) for r in R.retrieve_many(some, q, 4).collect()} == {("lexical", R.NO_MENTION_VECTORS)}


def test_running_top_k_sends_few_rows_for_many_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(900, 3)), 1)  # many ties
    points[np.linalg.norm(points, axis=1) == 0] = 1.0
    rows = [(f"m{i:03d}", [float(x) for x in p / np.linalg.norm(p)]) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "mention_id string, unit array<double>").coalesce(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        asked = vectors.limit(30).select(F.concat(F.lit("q"), "mention_id").alias("question_id"), "unit")
        units = np.array([r[1] for r in rows])
        want = {}
        for i in range(30):
            s = np.round(units @ np.array(rows[i][1]), 12)
            want[f"qm{i:03d}"] = [rows[j][0] for j in sorted(range(900), key=lambda j: (-s[j], rows[j][0]))[:6]]
        for limit in (32_768, 11):  # one pass, and several
            monkeypatch.setattr(V, "MAX_QUESTIONS", limit)
            got = {}
            for r in V.cosine_top_k_many(vectors, asked, 6).orderBy("rank").collect():
                got.setdefault(r["question_id"], []).append(r["mention_id"])
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_keeps_no_more_than_k(spark):
    rng = np.random.default_rng(1)
    best, names, scores = V._Best(5, 4), [], []
    for b in range(12):
        part = np.round(rng.normal(size=(5, 17)), 1)
        own = np.array([f"v{b:02d}{i:02d}" for i in rng.permutation(17)])
        best.add(part, own)
        assert len(best.question) <= 20
        names.append(own)
        scores.append(part)
    names, scores = np.concatenate(names), np.concatenate(scores, axis=1)
    for q in range(5):
        want = sorted(range(len(names)), key=lambda i: (-scores[q, i], names[i]))[:4]
        assert best.name[best.question == q].tolist() == names[want].tolist()
