import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from earshot.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, slip=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(words, ratio=5):
    out, forms = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (len(found), forms[w])
    result = {}
    for w, (k, form) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        result[w] = (form, root, words[w], k, words[form] if form else None)
    return result


def misspelt(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcxyzéß÷") + word[k:], word[:k] + rng.choice("abcxyzéß") + word[k + 1 :]])


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(4)
    base = ["".join(rng.choice("aabcdeeéiorstuß") for _ in range(rng.randrange(6, 11))) for _ in range(150)]
    out = {}
    for w in base:
        out[w] = rng.randrange(5, 400)
        for _ in range(rng.randrange(9)):
            v = misspelt(rng, w)
            out[v] = rng.choice([5, 7, 30, out[w]])
            out[misspelt(rng, v)] = 5
    return {w: n for w, n in out.items() if len(w) >= 6}


def got(table):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in table.collect()}


def test_variants_match_brute_force(spark, vocabulary):
    rows = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    want = brute(vocabulary)
    assert any(w[1] != w[0] and w[0] for w in want.values())
    assert any(r[1] != r[0] and r[0] is not None for r in want.values())  # chains of forms
    assert got(spelling.variants(rows)) == want


def test_blocks_and_parts_lose_nothing(spark, vocabulary, monkeypatch):
    # Cuts of a poor sample, tiny blocks, tiny parts; the limits are read on the driver.
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 9)
    monkeypatch.setattr(spelling, "PART_SEARCHES", 7)
    monkeypatch.setattr(spelling, "SAMPLE", 200)
    rows = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    assert max(t.n for t in spelling.cuts(rows).values()) > 8
    assert got(spelling.variants(rows)) == brute(vocabulary)


def test_tree_search_equals_all_pairs():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(700)})
    asked = sorted({"".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(90)})
    p, q = spelling.points(words), spelling.points(asked)
    for up, down in ((1, 1), (1, 0)):
        found = {(a, b) for x, y in spelling.Tree(p).near(q, up, down) for a, b in zip(x.tolist(), y.tolist())}
        gap = p[None] - q[:, None]
        a, b = np.nonzero((np.maximum(gap, 0).sum(2) <= up) & (np.maximum(-gap, 0).sum(2) <= down))
        assert found == set(zip(a.tolist(), b.tolist()))


def test_words_of_documents(spark, prose, monkeypatch):
    docs = [(i, prose(i % 7, 120) + " Straße STRASSE naïveté x×y÷z " * 3) for i in range(60)]
    docs += [(7, None), (8, ""), (None, "Wörter wörter Wörter wörter wörter Wörter"), (9, "q" * 200_000 + " "), (9, ("q" * 200_000 + " ") * 5)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(4)
    want = brute_words(docs, slip=19)
    assert any(w.startswith("qqq") for w in want)
    assert {r.word: r.n for r in spelling.word_counts(rows, slip=19).collect()} == want
    assert got(spelling.variants(spelling.word_counts(rows, slip=19))) == brute(want)
    batches = [pa.RecordBatch.from_pydict({"id": [str(i)], "text": [t.encode()]}) for i, t in docs[:40]]
    monkeypatch.setattr(spelling, "TABLE_WORDS", 50)
    total = Counter()
    for made in spelling._counted(batches, 19):
        total.update(dict(zip(made["word"].to_pylist(), made["n"].to_pylist())))
    assert {w: n for w, n in total.items() if n >= 5} == brute_words(docs[:40], slip=19)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(rows)).collect() == []


def test_query(spark):
    from earshot.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert got(QUERIES["op11_spelling_variants"](spark, path)) == brute(brute_words(docs))
