import math
import random

import numpy as np
import pytest

from earshot.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Rounds of sharing, as the contract words them."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def brute_price(sizes, target, most=3):
    """Price of one source by halving."""
    scale = max(sum(sizes) / len(sizes), 1e-9)
    taken = lambda p: sum(z * min(most, math.exp(min(p * z / scale, 50))) for z in sizes)
    low, high = -1e4, 1e4
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle) < target else (low, middle)
    return low, scale


def documents(rng, n=900, extra=()):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", "z", None])
        size = rng.choice([0, 1, 3, 10, 10, 10, 50, 51, 300, rng.randrange(400)])
        rows.append((i, " ".join(["w"] * size) if size else rng.choice(["", None, " \t"]), source))
    return rows + list(extra)


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def test_targets_rates_and_words_taken(spark):
    rng = random.Random(1)
    docs = documents(rng, extra=[(10_000 + k, "v " * 4, "tiny") for k in range(3)] + [(20_000, "long " * 9000, "e"), (20_001, "w " * 7, "e"), (20_002, "w", "e")])
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(table).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in docs)
    assert {r.doc_id: r.size for r in got} == {d[0]: len((d[1] or "").split()) for d in docs}
    sizes = {s: sum(r.size for r in own) for s, own in by_source(got).items()}
    want = brute_targets(sizes)
    assert want["tiny"] == 36  # full
    for source, own in by_source(got).items():
        assert all(r.source_size == sizes[source] for r in own)
        assert all(r.target == pytest.approx(want[source]) for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        # One document has nearly all words of a source: its copies decide.
        assert sum(r.taken for r in own) == pytest.approx(want[source], abs=4500 if source == "e" else 3)
        price, scale = brute_price([r.size for r in own], want[source])
        for r in own:
            if want[source] < 3 * sizes[source]:
                assert r.rate == pytest.approx(min(3, math.exp(price * r.size / scale)), rel=1e-5)
            # Copies stay at the rate's own whole numbers, but for what makes up the words.
            assert abs(r.copies - r.rate) < 2
    assert sum(abs(r.copies - r.rate) >= 1 for r in got) <= 40
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_rates_are_the_closest_in_relative_entropy(spark):
    """No change of two rates that keeps the words lowers the sum of r log r - r."""
    docs = [(i, "w " * (1 + i % 23), "s") for i in range(200)] + [(1000 + i, "w " * 9, "t") for i in range(150)]
    got = [r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect() if r.source == "s"]
    rates = {r.size: r.rate for r in got}
    cost = lambda x: x * np.log(x) - x
    for a in rates:
        for b in rates:
            for step in (1e-3, -1e-3):
                x, y = rates[a] + step, rates[b] - step * a / b
                if a != b and 0 < x <= 3 and 0 < y <= 3:
                    assert cost(x) + cost(y) >= cost(rates[a]) + cost(rates[b]) - 1e-9


def test_many_rows_of_one_size_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    docs = [(i, "w w w", "a") for i in range(700)] + [(5000, "x y z", "a")] * 500 + [(6000 + i, "w " * 11, "b") for i in range(300)] + [(None, "q r", None)] * 90
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    for limit in (200_000, 0):  # sent to the workers, or joined
        monkeypatch.setattr(mixing, "MAX_BROADCAST_ROWS", limit)
        got = mixing.mix(table).collect()
        assert len(got) == len(docs)
        for source, own in by_source(got).items():
            assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=max(r.size for r in own))
            copies = [r.copies for r in own]
            assert max(copies) - min(copies) <= 1 or source == "a"


def test_odd_rows_and_repeats(spark, odd_docs):
    docs = odd_docs().withColumn("taken", mixing.F.lit("x"))
    got = mixing.mix(docs)
    assert [c for c in got.columns if c not in docs.columns] == ["source_size", "target", "rate", "copies"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert {r.size for r in rows if r.text is None or not r.text.strip()} == {0}
    assert sum(r.taken for r in rows) == mixing.repeated(got).select(mixing.words("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_query(spark):
    from earshot.llm.queries import QUERIES

    rows = QUERIES["op13_source_mix"](spark, "/root/testdata/sf0.01").collect()
    sources = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect():
        sources[r.doc_id] = r.source
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.01 * target[s]  # a source has some 50 documents here
