import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import common, language, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_quality_on_held_out_labels(spark, data):
    docs, labels = data
    held = common.crc_bucket("doc_id", 2) == 1
    weights = quality.fit(docs, labels.where(~held))
    got = quality.posteriors(docs, weights, keep=["doc_id"]).join(labels.where(held), "doc_id").collect()
    good = [r.accepted for r in got if r.quality == 1]
    bad = [r.accepted for r in got if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_sparse_sites_are_drawn_to_the_mean(spark):
    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.9)] * 3 + [("low", "a", 0.2)] * 300 + [("one", "a", 0.01)] + [("big", "new", 0.1)]
    stats = {(r.host, r.path): r for r in quality.site_statistics(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path").collect()}
    assert len(stats) == 5 and stats["big", "b"].n_host == 304 and stats["big", "b"].n_path == 3
    g, k = stats["one", "a"].g, stats["one", "a"].k_host
    assert g == pytest.approx(np.mean([r[2] for r in rows])) and k >= 2
    mean = lambda s, n, k, prior: (s + k * prior) / (n + k)
    assert abs(mean(0.01, 1, k, g) - g) < abs(mean(60, 300, k, g) - g) + 0.3


def test_large_site_tables_take_the_salted_join(spark, data, monkeypatch):
    docs, labels = data
    weights = quality.fit(docs, labels)
    few = sorted(map(str, quality.posteriors(docs, weights, keep=["doc_id"]).select("doc_id", F.round("posterior", 9), "accepted").collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST_GROUPS", 0)
    many = sorted(map(str, quality.posteriors(docs, weights, keep=["doc_id"]).select("doc_id", F.round("posterior", 9), "accepted").collect()))
    assert few == many


def test_quality_odd_rows(spark, odd_docs, data):
    docs = odd_docs()
    out = quality.accepted(docs, data[1].limit(0))
    assert out.columns == docs.columns and out.count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, None), (None, 0), (77, 0)], "doc_id long, quality int")
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.accepted(docs.limit(0), data[1]).count() == 0


def test_toxicity_learns_words_and_misspellings():
    import random

    rng = random.Random(4)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    bad = ["grumblefool", "nastyface", "rottenhead"]
    texts, y = [], []
    for k in range(400):
        ws = [rng.choice(plain) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(2):
                ws[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(ws).encode())
        y.append(float(k % 4 == 0))
    model = toxicity.train(texts[:300], np.array(y[:300]))
    score = [model.score(t) for t in texts[300:]]
    assert np.mean([s >= 0.7 for s, v in zip(score, y[300:]) if v]) > 0.9
    assert np.mean([s >= 0.7 for s, v in zip(score, y[300:]) if not v]) < 0.1
    clean = " ".join(plain[:40])
    assert model.score(f"{clean} grumblef00l nastyfacce".encode()) > model.score(clean.encode()) + 0.2
    assert 0 <= model.score(b"") <= 1


def test_n_grams_are_of_the_whole_word():
    rng = np.random.default_rng(3)
    start = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 80))
    rows, owner = common.char_grams([start + "abcdef", start, "abcdef"], range(3, 7), 1 << 17)
    assert len(rows[owner == 0]) == sum(88 - n + 1 for n in range(3, 7))
    parts = np.zeros(toxicity.BUCKETS)
    parts[common.char_grams(["abcdef"], range(6, 7), toxicity.BUCKETS)[0]] = 1000.0
    model = toxicity.Model(parts, 0.0)
    assert model.score((start + "abcdef").encode()) > model.score((start + "zzzzzz").encode()) + 0.2
    known = language.train([("aa", "kanimo " * 50), ("bb", "sutero " * 50)])
    assert known.word_scores(["x" * 60 + "sutero"])[0].argmax() == 1 and known.word_scores(["x" * 60 + "kanimo"])[0].argmax() == 0
    words = ["a" * k for k in range(1, 60)] + ["b" * 900]
    assert [w for part in common.word_parts(words, 100) for w in part] == words


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc_bucket("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs.where(held), model, keep=["doc_id"]).join(labels, "doc_id").collect()
    x = np.array([r.score for r in got])
    y = np.array([r.toxic for r in got])
    rank = np.argsort(np.argsort(x)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    assert np.mean(x[y == 1] >= toxicity.THRESHOLD) > 0.6 and np.mean(x[y == 0] >= toxicity.THRESHOLD) < 0.03


def test_toxicity_odd_rows(spark, odd_docs):
    docs = odd_docs()
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, None), (None, 0), (77, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        out = toxicity.score(docs, toxicity.fit(docs, known))
        assert out.count() == docs.count() and out.where("score >= 0 AND score <= 1").count() == docs.count()
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_language_held_out(spark, data):
    docs, _ = data
    held = common.crc_bucket("doc_id", 4) == 2
    model = language.fit(docs.where(~held))
    got = language.identify(docs.where(held), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.normal(size=(6, 3)) * 3
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(product(range(3), repeat=6), key=cost)
        assert cost(language.viterbi(s, 2.0)) == pytest.approx(cost(best))


def test_short_cut_agrees_with_the_walk(spark, data, monkeypatch):
    docs, _ = data
    model = language.fit(docs)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    texts += [texts[0][:300] + " " + texts[1][:300], texts[2][:40] + " " + texts[3]]
    for text in texts:
        words = [w.lower() for w in language._WORD.findall(text)]
        if words:
            model.learn(set(words))
            labels = model.label(words)
            scores = model._rows(words)
            cost = lambda p: scores[np.arange(len(p)), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
            assert cost(labels) == pytest.approx(cost(language.viterbi(scores)))


def test_short_cut_is_exact_on_any_scores(monkeypatch):
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], np.zeros((language.BUCKETS, 3)), {})
    walked = []
    walk = language.viterbi
    monkeypatch.setattr(language, "viterbi", lambda s: walked.append(1) or walk(s))
    tables = [np.array([[0, -6, -2]] * 5 + [[-6, 0, -2]] * 5, dtype=float)]  # a compromise has the best sum
    for _ in range(4000):
        s = rng.uniform(-6, 0, size=(rng.integers(1, 16), 3))
        s[rng.random(s.shape) < 0.3] = 0
        tables.append(s * rng.choice([0.2, 0.5, 1.0]))
    for s in tables:
        monkeypatch.setattr(model, "_rows", lambda words: s)
        labels = model.label(["w"] * len(s))
        cost = lambda p: s[np.arange(len(p)), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
        assert cost(labels) == pytest.approx(cost(walk(s)))
    assert len(walked) < len(tables) / 2


def test_mixed_text_has_spans_and_scripts_narrow(spark):
    model = language.train([("ru", "привет как дела сегодня хорошо " * 20), ("en", "the weather is good today hello there " * 20), ("de", "das wetter ist heute gut und schön " * 20)])
    text = "the weather is good today hello there the weather is good. das wetter ist heute gut und schön das wetter ist heute gut и привет как дела сегодня"
    spans, _, _ = model.spans(text)
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert text[spans[2][0] : spans[2][1]].startswith("и привет")
    assert model.word_scores(["слово"])[0][model.langs.index("de")] <= -language.WORD_LIMIT
    assert model.word_scores(["ελλάδα"]).tolist() == [[0, 0, 0]]
    assert model.spans("12 %% 3") == ([], "und", 0.0)


def test_unspaced_stretches_are_of_their_script():
    rng = np.random.default_rng(5)
    han = lambda n, low=0x4E00: "".join(chr(c) for c in rng.integers(low, low + 400, n))
    a, b = han(12), han(12, 0x5200)
    samples = [("en", "the weather is good today hello there " * 20), ("zh", "。".join(han(12) + a * 3 for _ in range(60))), ("ja", "。".join(han(6, 0x5200) + "のですがとはにを" + b * 3 for _ in range(60)))]
    model = language.train(samples)
    text = f"Hello there, the weather is good. {han(330)}，{han(330)}，{han(340)}。 The weather is good today."
    spans, lang, score = model.spans(text)
    assert [s[2] for s in spans] == ["en", "zh", "en"] and lang == "zh" and score > 0.9
    # Script changes without a space between.
    joined = "hello" + han(30) + "there"
    spans, lang, _ = model.spans(joined)
    assert [joined[a:b] for a, b, _ in spans] == ["hello", joined[5:35], "there"] and lang == "zh"
    # A long stretch outweighs the switches, a short one does not, in a script of two languages.
    assert [s[2] for s in model.spans(f"{b * 5}，{a * 4}，{b * 5}")[0]] == ["ja", "zh", "ja"]
    assert [s[2] for s in model.spans(f"{b * 5}，{a[:2]}，{b * 5}")[0]] == ["ja"]


def test_language_sample_takes_an_id_once(spark, monkeypatch):
    rows = [(1, "hello weather", "en")] * 300 + [(1, "hallo wetter", "de"), (2, "good day", "en"), (2, "another day", "en"), (2, "x", None)]
    seen = []
    monkeypatch.setattr(language, "train", seen.extend)
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert sorted(seen) == [("de", "hallo wetter"), ("en", "another day"), ("en", "hello weather")]


def test_language_odd_rows(spark, odd_docs):
    docs = odd_docs()
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if not (r.text or "").strip())
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
