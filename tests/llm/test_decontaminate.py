import random
import re

import pytest

from earshot.llm import decontaminate as D


def brute(items, doc, window):
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate({i: i + 32 for i in range(65, 91)}))
    d, hit, found = cut(doc), set(), set()
    for name, text in items:
        w = cut(text)
        for x in [w] if 0 < len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)]:
            for i in range(len(d) - len(x) + 1):
                if d[i : i + len(x)] == x:
                    found.add(name)
                    hit.update(range(i, i + len(x)))
    return len(d), hit, found


@pytest.mark.parametrize("seed", range(4))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        window = rng.choice([2, 3, 4, 10])
        letters = ["a", "b", "é", "C1"][: rng.randint(1, 4)]
        items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for k in range(rng.randint(0, 5))]
        doc = ", ".join(rng.choice([*letters, "z"]) for _ in range(rng.randint(0, 40)))
        automaton = D.Automaton([(n, D.words(t.encode())) for n, t in items], window)
        ranges, found = automaton.find(D.words(doc.encode()))
        hit = {p for a, b in D.merged(ranges) for p in range(a, b)}
        assert (len(D.words(doc.encode())), hit, found) == brute(items, doc, window)


def test_blocks_give_the_same_hits(spark, prose):
    items = [(i, prose(i, 25)) for i in range(12)] + [(50, "short item"), (51, None), (52, ""), (None, prose(0, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, f"{prose(700 + k, 20)} {prose(k, 25)[:80]} Short, ITEM {prose(k + 1, 25)}") for k in range(11)] + [(90, prose(90, 60)), (91, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    known = [(str(i), t) for i, t in items if i is not None and t]
    for block_words in (10**6, 60):
        got = D.find_hits(table, bench, keep=["doc_id"], block_words=block_words).withColumn("n_hit", D.hit_words()).collect()
        for r in got:
            n, hit, found = brute(known, dict(docs)[r.doc_id] or "", 10)
            assert (r.n_words, r.n_hit, set(r["items"])) == (n, len(hit), found)
    assert len(D.blocks(bench, block_words=60)) > 3


def test_clean_cuts_spans_and_drops_covered_documents(spark, prose):
    item = prose(1, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Before it. {item} after, {prose(2, 60)}"), (2, item + " tail"), (3, prose(3, 50)), (4, " ".join(item.split()[:9]) + " " + prose(5, 20))]
    out = {r.doc_id: r.text for r in D.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1] == f"Before it.  after, {prose(2, 60)}" and out[3] == rows[2][1] and out[4] == rows[3][1]


def test_clean_cuts_short_items(spark, prose):
    item, long = prose(1, 6), prose(2, 30)
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = [(1, f"{prose(3, 80)} Here: {item.upper()}! {prose(4, 40)}"), (2, f"{prose(5, 60)} {' '.join(item.split()[:5])} {prose(6, 9)}"), (3, f"{item} {prose(7, 60)} {long} {item} z")]
    out = {r.doc_id: r.text for r in D.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: f"{prose(3, 80)} Here: ! {prose(4, 40)}", 2: rows[1][1], 3: f" {prose(7, 60)}  z"}


def test_odd_rows(spark, odd_docs):
    docs = odd_docs()
    bench = spark.createDataFrame([(1, "six seven"), (1, "six seven"), (2, None), (None, "one two")], "item_id long, text string")
    hits = D.find_hits(docs, bench, keep=["doc_id"]).withColumn("n_hit", D.hit_words()).collect()
    assert sorted((r.doc_id or 0, r.n_hit, tuple(r["items"])) for r in hits)[:3] == [(0, 0, ()), (0, 2, ("1",)), (1, 2, ("1",))]
    out = D.clean(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    empty = D.clean(docs, bench.limit(0)).collect()
    assert sorted(map(str, empty)) == sorted(map(str, docs.collect()))
    assert D.clean(docs.limit(0), bench).count() == 0
