import random

import numpy as np

from earshot.llm import common, near_dedup


def brute(docs):
    """Components over exact resemblance of word tuples."""
    sets = {}
    for i, text in docs:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_match_brute_force(spark, prose):
    rng = random.Random(5)
    docs, i = [], 100
    for g in range(14):
        base = prose(g, rng.choice([3, 8, 60, 200, 400])).split()
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            docs.append((i, " ".join(copy)))
            i += rng.choice([1, 3])
    line = prose(99, 40)
    docs += [(1000 + k, line + " " + prose(500 + k, 30)) for k in range(40)]  # a shared passage, not near
    rng.shuffle(docs)
    got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_near_copies_is_one_component(spark, prose):
    base = prose(1, 300).split()
    docs = []
    for k in range(30):
        base[k * 9 : k * 9 + 3] = [f"x{k}a", f"x{k}b", f"x{k}c"]
        docs.append((50 - k, " ".join(base)))
    got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {21}
    assert brute(docs)[50][1] == 21


def test_odd_rows(spark, odd_docs):
    docs = odd_docs()
    got = near_dedup.near_components(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and all(r.kept for r in by[1])
    assert [(r.n_shingles, r.component_id) for r in by[3]] == [(0, 3)] == [(r.n_shingles, r.component_id - 1) for r in by[4]]
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[5][0].n_shingles == 1
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1  # the repeated row
    assert near_dedup.near_components(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_nodes_of_their_own(spark, prose):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(7, a), (7, b), (7, near(b)), (8, near(a)), (9, near(b)), (10, b), (11, a), (3, c), (12, near(c)), (12, prose(4, 80)), (13, prose(5, 80)), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_components(table).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (7, 7), (7, 7), (7, 7), (8, 7), (9, 7), (10, 7), (11, 7), (12, 3), (12, 12), (13, 13)]
    left = sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(table).collect())
    assert [i for i, _ in left] == [0, 3, 7, 7, 12, 13]
    assert {t for i, t in left if i == 7} in ({a, b}, {a, near(b)}) and (12, prose(4, 80)) in left


def test_half_keys_agree_with_resemblance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    b = np.concatenate([a[:350], rng.integers(0, 1 << 62, 50, dtype=np.uint64)])
    k = near_dedup.half_keys([np.sort(a), np.sort(b)])
    share = (k[0] == k[1]).mean()
    assert 0.2 < share <= 1.0 and k.shape == (2, 2 * near_dedup.HALVES)
    assert (near_dedup.half_keys([a[:0]]) == 0).all()


def test_shingles():
    assert len(common.shingles(b"")) == len(common.shingles(b" \n")) == 0
    assert len(common.shingles(b"a b")) == 1 and len(common.shingles(b"a b c d e f")) == 2
    assert common.shingles(b"A b\tC d\x0be") == common.shingles(b"a b c d e")
    assert common.shingles(b"a b c") != common.shingles(b"a b c d")


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = common.min_label_edges(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.u: r.root for r in got} == {**{k: 0 for k in range(1, 41)}, 100: 90, 95: 90}


def test_links_of_a_block_are_a_forest(prose):
    import pyarrow as pa

    sets = [common.shingles(prose(k // 40, 60).encode()) for k in range(120)]  # three groups of copies
    sets += [common.shingles(prose(1000 + k, 60).encode()) for k in range(20)]
    lists = common.list_array([s.view(np.int64) for s in sets], pa.int64())
    nodes = np.arange(len(sets), dtype=np.int64) * 7
    queries = pa.table({"query": nodes[:100], "query_shingles": lists.slice(0, 100)})
    rows = pa.table({"node": nodes[30:], "shingles": lists.slice(30)})
    made = near_dedup._links_of_block(queries, rows).to_pydict()
    links = list(zip(made["u"], made["v"]))
    assert len(links) < len(nodes)
    root = {n: n for n in nodes.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert a // 7 // 40 == b // 7 // 40 and max(a, b) // 7 < 120
        assert find(a) != find(b)
        root[find(a)] = find(b)
    # Rows of a group are connected with each other and with the queries that they are near to.
    assert len({find(n * 7) for n in range(30, 40)} | {find(n * 7) for n in range(30)}) == 1
    assert len({find(n * 7) for n in range(40, 80)}) == 1
    assert len({find(n * 7) for n in range(80, 120)}) == 1


def test_worker_tables_go_when_another_operator_starts():
    common.use("a")
    common.shingles(b"one two three")
    common.use("a")
    assert len(common._HASHES) == 3
    common.shingles(b"x" * 100)
    assert len(common._HASHES) == 3  # long words are not kept
    common.use("b")
    assert not common._HASHES
