from pyspark.sql import functions as F

from earshot.llm import substring_dedup as S


def test_passages_are_found_and_cut_once(spark, prose):
    passage = prose(7, 55)
    short = prose(8, 12)  # as a license line
    docs = [(i, f"{prose(100 + i, 90)} {passage} {prose(200 + i, 70)}") for i in (5, 9, 11)]
    docs += [(i, f"{prose(300 + i, 120)}\n{short}\n{prose(400 + i, 30)}") for i in range(20, 30)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans for r in S.repeated_spans(table).select("row.doc_id", "spans").collect()}
    assert {i for i, s in spans.items() if s} == {9, 11}
    for i in (9, 11):
        (span,) = spans[i]
        text = dict(docs)[i].encode()
        assert span.keeper == 5 and span.n_words >= S.MIN_WORDS
        assert text[span.start : span.end].decode().strip() in passage
    clean = {r.doc_id: r.text for r in S.without_repeats(table).collect()}
    assert clean[5] == dict(docs)[5] and all(clean[i] == t for i, t in docs if i >= 20)
    assert all(len(clean[i].split()) < 90 + 70 + 36 for i in (9, 11))


def test_cuts_do_not_depend_on_what_stands_before(prose):
    text = prose(3, 400).encode()
    bounds, _ = S.chunks(text)
    shifted, _ = S.chunks(b"quite another start " + text)
    moved = {b - 20 for b in shifted}
    assert {b for b in bounds if b > 60} <= moved
    assert bounds[0] == 0 and bounds[-1] == len(text) and bounds == sorted(set(bounds))


def test_hash_is_the_gear_recurrence():
    text = bytes(range(65, 91)) * 3
    h = 0
    want = []
    for b in text:
        h = ((h << 1) + int(S._GEAR[b])) & 0xFFFF
        want.append(h)
    x = S._GEAR[list(text)]
    for m in (1, 2, 4, 8):
        import numpy as np

        x = np.concatenate([x[:m], x[m:] + (x[:-m] << np.uint16(m))])
    assert x.tolist()[15:] == want[15:]


def test_long_text_without_spaces_is_cut():
    import random

    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)).encode()
    bounds, _ = S.chunks(text)
    assert len(bounds) > 10
    assert b"".join(text[i:j] for i, j in zip(bounds, bounds[1:])) == text
    text[bounds[3] :].decode()  # a cut is at a character


def test_odd_rows(spark, odd_docs):
    docs = odd_docs()
    spans = S.repeated_spans(docs)
    assert spans.count() == docs.count() and spans.where(F.size("spans") > 0).count() == 0
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert S.without_repeats(docs.limit(0)).count() == 0
    # An exact copy of a long text goes whole, its keeper stays.
    two = odd_docs([(9, "alpha beta " + "gamma delta epsilon zeta " * 40, "en", "s", 1), (8, "alpha beta " + "gamma delta epsilon zeta " * 40, "en", "s", 1)])
    assert [r.doc_id for r in S.without_repeats(two).collect()] == [8]


def test_span_is_a_passage_of_one_earlier_document(spark, prose):
    # Most chunks of document 900 are known, but no neighbours stand in one earlier document.
    text = prose(58, 400)  # chunks of at most 12 words
    bounds, _ = S.chunks(text.encode())
    # With the two words before, which make the cut.
    pieces = [" ".join([*text[:i].split()[-2:], text[i:j].strip()]) for i, j in zip(bounds, bounds[1:])]
    docs = [(1 + k, f"{prose(1000 + k, 30)} {p} {prose(2000 + k, 30)}") for k, p in enumerate(pieces)] + [(900, text)]
    known = {d for _, t in docs[:-1] for d in S.digests(t.encode(), S.chunks(t.encode())[0])}
    assert sum(d in known for d in S.digests(text.encode(), bounds)) > len(pieces) / 2
    # A passage of document 901 is held by 902 too, a part of it by 0 as well.
    long = prose(60, 120)
    docs += [(0, prose(61, 40) + " " + " ".join(long.split()[40:90]) + " " + prose(62, 40)), (901, f"{prose(63, 50)} {long} {prose(64, 50)}"), (902, f"{prose(68, 50)} {long} {prose(66, 50)}")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans for r in S.repeated_spans(table).select("row.doc_id", "spans").collect()}
    assert {i for i, s in spans.items() if s} == {901, 902}
    assert {s.keeper for s in spans[902]} == {0, 901} and {s.keeper for s in spans[901]} == {0}
    for i in (901, 902):
        for s in spans[i]:
            assert dict(docs)[i].encode()[s.start : s.end].decode().strip() in dict(docs)[s.keeper] and s.n_words >= S.MIN_WORDS
    left = {r.doc_id: r.text for r in S.without_repeats(table).collect()}
    assert left[900] == text and len(left[902].split()) < 50 + 50 + 36


def test_repeated_unspaced_passages_are_cut(spark):
    import random
    import string

    rng = random.Random(2)
    make = {
        "han": lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
        "lines": lambda n: "\n".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(10)) for _ in range(n // 10)),
        "thai": lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n)),
        "base64": lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)),
    }
    docs, passages = [], {}
    for k, letters in enumerate(make.values()):
        passage = letters(600)
        for i in (10 * k + 1, 10 * k + 2):
            docs.append((i, f"{letters(200)}{passage}{letters(200)}"))
            passages[i] = passage
        docs.append((10 * k + 3, letters(300)))
        docs += [(10 * k + 4 + j, letters(60) + passage[100:112]) for j in (0, 1)]  # too short
    copy = make["han"](5000)
    docs += [(100, copy), (101, copy)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans for r in S.repeated_spans(table).select("row.doc_id", "spans").collect()}
    assert {i for i, s in spans.items() if s} == {2, 12, 22, 32, 101}
    for i in (2, 12, 22, 32):
        (span,) = spans[i]
        found = dict(docs)[i].encode()[span.start : span.end].decode()
        assert span.keeper == i - 1 and found.strip() in passages[i] and len(found) > 400
        assert span.n_words >= S.MIN_WORDS
    left = {r.doc_id: r.text for r in S.without_repeats(table).collect()}
    assert 101 not in left and left[100] == copy and all(left[i] == t for i, t in docs if not spans[i])
