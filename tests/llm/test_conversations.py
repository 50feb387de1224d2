import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from earshot.llm import conversations as K

WS = " \t\n\x0b\x0c\r"


def brute(messages):
    """Counts, cost, edits and what is left, by exhaustive search over rows and role initials."""
    seen, kinds = set(), []
    for m in messages:
        end = m[1].strip(WS)[-1:]
        kinds.append("blank" if not end else "duplicate" if m in seen else "truncated" if end not in ".!?" else "")
        seen.add(m)

    @lru_cache(None)
    def best(i, done):
        """(cost, edits, lines) from row i on after the initials s, u or a; '' before any."""
        expected = "a" if done == "u" else "u"
        options = [(0, "", ())] if i == len(messages) and done in ("", "a") else []
        name = {"u": "user", "a": "assistant"}[expected]
        if i < len(messages):
            role, text = messages[i]
            extra = 3 if kinds[i] == "truncated" else 0
            c, e, lines = best(i + 1, done)
            options.append((c + 4, "D" + e, lines))
            if kinds[i] in ("", "truncated"):
                if role[:1] == expected or (role[:1] == "s" and done == ""):
                    c, e, lines = best(i + 1, role[:1])
                    options.append((c + extra, "K" + e, (f"{role}:{text}", *lines)))
                c, e, lines = best(i + 1, expected)
                options.append((c + extra + 3, "R" + e, (f"{name}:{text}", *lines)))
        # At most two insertions in a row are of use.
        c, e, lines = inserted(i, expected, 2)
        if e is not None:
            options.append((c, e, lines))
        return min(options)

    def inserted(i, which, left):
        name = {"u": "user", "a": "assistant"}[which]
        c, e, lines = after_insert(i, which, left - 1)
        return c + 3, "I" + e, (f"{name}:", *lines)

    @lru_cache(None)
    def after_insert(i, done, left):
        expected = "a" if done == "u" else "u"
        options = [(0, "", ())] if i == len(messages) and done == "a" else []
        if i < len(messages):
            role, text = messages[i]
            extra = 3 if kinds[i] == "truncated" else 0
            name = {"u": "user", "a": "assistant"}[expected]
            c, e, lines = best(i + 1, done)
            options.append((c + 4, "D" + e, lines))
            if kinds[i] in ("", "truncated"):
                if role[:1] == expected:
                    c, e, lines = best(i + 1, role[:1])
                    options.append((c + extra, "K" + e, (f"{role}:{text}", *lines)))
                c, e, lines = best(i + 1, expected)
                options.append((c + extra + 3, "R" + e, (f"{name}:{text}", *lines)))
        if left:
            options.append(inserted(i, expected, left))
        return min(options) if options else (10**9, "", ())

    initials = [m[0][:1] for m in messages]
    cost, edits, lines = best(0, "")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def summary(messages, turns):
    t = [x for x in turns if x is not None]
    return (max(t) - min(t) + 1 - len(set(t)) if t else 0, *brute(messages))


def expected(rows):
    """From rows (conv, turn, role, text, lost)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv and not r[4]], key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
        out[conv] = summary([(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in own], [r[1] for r in own])
    return out


def got(table):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in table.collect()}


def talk(rng, conv, n):
    roles = ["user", "assistant"] * n
    if rng.random() < 0.3:
        roles.insert(0, "system")
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.2 else roles[i]
        text = rng.choice(["", " \t", None, "Same.", "cut off", "Same.", f"cut {i}"]) if rng.random() < 0.35 else f"Answer {i} of {conv}!"
        turn = None if rng.random() < 0.05 else i + (i > n // 2)
        rows.append((conv, turn, role, text, rng.random() < 0.08))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, lost boolean"


def test_repairs_match_exhaustive_search(spark):
    rng = random.Random(2)
    rows = [r for c in range(300) for r in talk(rng, c if c else None, rng.randrange(1, 14))]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(K.audits(table, lost_col="lost")) == expected(rows)


def test_long_conversations_in_fragments_match_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(K, "LONG_ROWS", 7)
    rng = random.Random(6)
    rows = [r for c in range(40) for r in talk(rng, c if c else None, rng.choice([3, 20, 60, 90]))]
    rows += [(900, i, "assistant" if i % 3 else "user", "Same.", False) for i in range(60)]
    rows += [(901, 5, "user", "Hi.", False)] * 40 + [(902, None, None, None, False)] * 30 + [(903, i, "system", f"S{i}.", False) for i in range(30)]
    rows += [(904, i, "user", "x.", True) for i in range(30)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(K.audits(table, lost_col="lost")) == expected(rows)
    left = {}
    for r in K.repaired(table, lost_col="lost").orderBy("place").collect():
        left.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    want = expected(rows)
    for conv, found in left.items():
        assert [p for p, _ in found] == list(range(len(found)))
        assert hashlib.sha256("\n".join(x for _, x in found).encode()).hexdigest() == want[conv][-1]
    assert set(left) == {c for c in want if set(want[c][-2]) - {"D"}}


def test_transfers_are_the_costs_between_states():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4)) for _ in range(rng.randrange(1, 7))]
        # Relaxation over all nodes until nothing changes.
        for start in range(4):
            cost = {(0, start): 0}
            while True:
                new = dict(cost)
                for (i, s), c in cost.items():
                    if i == len(rows):
                        continue
                    fault, code = rows[i]
                    arcs = [((i + 1, s), 4), ((i, K.NEXT[s]), 3)]
                    if fault in (0, 3):
                        more = 3 if fault == 3 else 0
                        arcs.append(((i + 1, K.NEXT[s]), 3 + more))
                        if K.AFTER[s][code] >= 0:
                            arcs.append(((i + 1, K.AFTER[s][code]), more))
                    for to, w in arcs:
                        new[to] = min(new.get(to, K.NEVER), c + w)
                if new == cost:
                    break
                cost = new
            assert [cost.get((len(rows), e), K.NEVER) for e in range(4)] == K.transfers(rows)[4 * start : 4 * start + 4]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    return out


def test_query_and_odd_rows(spark):
    from earshot.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, path)) == expected(damaged(rows))
    odd = [(None, None, None, None, 1), (None, 1, "user", "x" * 300_000, 2), (3, None, "user", "", 3), (3, None, "user", "", 3), (4, 2, "assistant", " ", None)]
    table = spark.createDataFrame([(*r, "k") for r in odd], "conv_id long, turn long, role string, text string, conv long, part string")
    assert got(K.audits(K.damaged(table), "conv", "turn", "role", "text", "lost").withColumnRenamed("conv", "conv_id")) == expected(damaged([r[:4] for r in odd]))
    assert K.audits(table.limit(0)).collect() == []


@pytest.mark.parametrize("n", [400])
def test_a_long_search_ends_soon(n):
    rng = random.Random(n)
    rows = [(rng.choice([0] * 8 + [1, 2, 3]), rng.choice([1, 2, 2, 1, 3])) for _ in range(n)]
    cost, letters = K.solve(rows)
    assert cost > 0 and len(letters.replace("I", "")) == n
