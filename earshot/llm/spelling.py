"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

A word is a point: how often it has each letter (26 of them, others share six counts). One inserted
letter adds 1 to one count, one replaced letter moves 1 from a count to another or leaves all as they
are; so near words of one length are at most two apart in L1 distance, one up and one down, and a word
and a longer near word are one apart, up. Words of each length have a k-d tree of their own, which words
of that length and those one letter shorter search.

The upper levels of a length's tree cut its words into blocks of about ``BLOCK_WORDS``, each a task; the
cuts are medians of a bounded sample, but every word is in a block and every search is whole. A word goes
to each block that one move up and one down, or one move up, can reach. Blocks that many words search are
searched in parts. Inside a block, the tree's nodes have the bounding box of their words: searches that
one edit cannot bring into a box end there. What reaches a leaf is compared by counts, then by the
order of letters.

Only counts of near words and the best one leave a block, not pairs. Chains of forms are followed by
pointer jumping; each form is ``RATIO`` times as frequent as the word, so chains are short.

Words are counted with a table of bounded size in each task before the shuffle.

Odd input: null texts have no words; a null id counts as an empty one where ids matter. Repeated rows
are counted again. Words of any length are whole keys. Ties go to the word that is least in code points.
Empty tables give empty ones. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: One in so many runs of letters (by checksum with the id) loses a letter in ``slipped`` counts.
SLIP = 199
#: Words of a block, searches of a part of it, words of a leaf.
BLOCK_WORDS = 20_000
PART_SEARCHES = 100_000
LEAF = 12
#: Words whose counts place the cuts between blocks, about (by their hashes).
SAMPLE = 50_000
#: Pairs of counts that are compared at once, about.
PAIRS = 50_000
#: Different words of a task's counting table, and bytes of them, about.
TABLE_WORDS = 200_000
TABLE_BYTES = 16 << 20

DIMENSIONS = 32
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _counted(batches: Iterator[pa.RecordBatch], slip: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the runs of letters in rows of (id, text), each word a few times at most."""
    C.use(__name__)
    table: Counter = Counter()
    size = 0

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(table.keys()), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])
        table.clear()
        return made

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # Only A-Z change in bytes.lower().
            runs = Counter(_RUN.findall(text.lower().decode("utf-8", "replace")))
            start = zlib.crc32(f"{own}:".encode())
            for run, n in runs.items():
                if slip:
                    h = zlib.crc32(run.encode(), start)
                    if h % slip == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                if len(run) >= MIN_LETTERS:
                    if run not in table:
                        size += len(run)
                    table[run] += n
            if len(table) >= TABLE_WORDS or size >= TABLE_BYTES:
                yield flush()
                size = 0
    if table:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 0, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``MIN_LETTERS`` letters and ``min_count`` occurrences.

    ``slip`` (0: none) takes a letter from those runs whose checksum with the id it divides.
    """
    C.prepare(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), C.utf8(f"`{text_col}`").alias("text"))
    some = slim.mapInArrow(lambda batches: _counted(batches, slip), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def points(words: list[str]) -> np.ndarray:
    """One row of letter counts for each word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    place = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % (DIMENSIONS - 26))
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * DIMENSIONS + place, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


def _best_cut(p: np.ndarray) -> tuple[int, int] | None:
    """The count (dimension) and cut that part points most evenly: cut or more on one side, less on the other."""
    best, found = 0, None
    for d in np.argsort(-p.var(axis=0), kind="stable")[:6].tolist():
        values = np.sort(p[:, d])
        middle = values[len(values) // 2]
        for cut in (middle, middle + 1):
            above = len(values) - int(np.searchsorted(values, cut))
            even = min(above, len(values) - above)
            if even > best:
                best, found = even, (d, int(cut))
    return found


class Blocks:
    """Upper levels of one length's tree: cuts, and the number of the block below each last one."""

    def __init__(self, p: np.ndarray, n_blocks: float):
        self.n = 0
        self.root = self._part(p, n_blocks)

    def _part(self, p: np.ndarray, n_blocks: float):
        cut = _best_cut(p) if n_blocks > 1 and len(p) > 1 else None
        if cut is None:
            self.n += 1
            return self.n - 1
        above = p[:, cut[0]] >= cut[1]
        return cut, self._part(p[~above], n_blocks / 2), self._part(p[above], n_blocks / 2)

    def reached(self, p: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of points and the blocks that so many moves up and down can bring them to."""
        rows, blocks = [], []

        def walk(node, at: np.ndarray, ups: np.ndarray, downs: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at)
                blocks.append(np.full(len(at), node, dtype=np.int64))
                return
            (d, cut), less, more = node
            short = cut - p[at, d]  # moves up that the upper side needs
            over = 1 - short  # moves down that the lower side needs
            use_up, use_down = np.maximum(short, 0), np.maximum(over, 0)
            ok = use_up <= ups
            walk(more, at[ok], ups[ok] - use_up[ok], downs[ok])
            ok = use_down <= downs
            walk(less, at[ok], ups[ok], downs[ok] - use_down[ok])

        n = len(p)
        walk(self.root, np.arange(n), np.full(n, up), np.full(n, down))
        return (np.concatenate(rows), np.concatenate(blocks)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class Tree:
    """k-d tree of points with the bounding box of each node."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.root = self._node(np.arange(len(p)))

    def _node(self, at: np.ndarray):
        own = self.p[at]
        low, high = own.min(0), own.max(0)
        cut = _best_cut(own) if len(at) > LEAF else None
        if cut is None:
            return low, high, at, None
        above = own[:, cut[0]] >= cut[1]
        return low, high, None, (self._node(at[~above]), self._node(at[above]))

    def near(self, q: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``q``, point) that at most ``up`` counts plus and ``down`` minus turn into each other."""
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            (low, high, at, below), asked = stack.pop()
            own = q[asked]
            inside = (np.maximum(low - own, 0).sum(1) <= up) & (np.maximum(own - high, 0).sum(1) <= down)
            asked = asked[inside]
            if not len(asked):
                continue
            if below is not None:
                stack += [(child, asked) for child in below]
                continue
            for part in np.array_split(asked, -(-len(asked) * len(at) // PAIRS)):
                gap = self.p[at][None, :, :] - q[part][:, None, :]
                a, b = np.nonzero((np.maximum(gap, 0).sum(2) <= up) & (np.maximum(-gap, 0).sum(2) <= down))
                yield part[a], at[b]


def one_replaced(a: str, b: str) -> bool:
    """Words of one length that differ in exactly one place."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
    return i is not None and a[i + 1 :] == b[i + 1 :]


def one_inserted(a: str, b: str) -> bool:
    """The second word is the first one with one letter more."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def _searched(table: pa.Table) -> pa.Table:
    """Of a part of a block: for each word the number of near words found and the best of them."""
    C.use(__name__)
    word, n, kind = (table[c].to_pylist() for c in ("word", "n", "kind"))
    home = [i for i, k in enumerate(kind) if k == 0]
    found: dict[str, list] = {}

    def note(i: int, j: int) -> None:
        best = (-n[j], word[j])
        old = found.get(word[i])
        if old is None:
            found[word[i]] = [1, best]
        else:
            old[0] += 1
            old[1] = min(old[1], best)

    if home:
        tree = Tree(points([word[i] for i in home]))
        for own, (up, down) in ((1, (1, 1)), (2, (1, 0))):
            asked = [i for i, k in enumerate(kind) if k == own]
            if not asked:
                continue
            same = one_replaced if own == 1 else one_inserted
            for a, b in tree.near(points([word[i] for i in asked]), up, down):
                for x, y in zip(a.tolist(), b.tolist()):
                    i, j = asked[x], home[y]
                    if same(word[i], word[j]):
                        note(i, j)
                        if own == 2:
                            note(j, i)
    names = list(found)
    best = [found[w][1] for w in names]
    return pa.table(
        {
            "word": pa.array(names, pa.string()),
            "n_near": pa.array([found[w][0] for w in names], pa.int64()),
            "less": pa.array([b[0] for b in best], pa.int64()),
            "best": pa.array([b[1] for b in best], pa.string()),
        }
    )


def cuts(words: DataFrame) -> dict[int, Blocks]:
    """Upper levels of the tree of each length that has more words than a block takes."""
    sizes = words.groupBy(F.length("word").alias("k")).count().where(F.col("count") > BLOCK_WORDS).collect()  # few: a length each
    if not sizes:
        return {}
    # A share of the hashes that about ``SAMPLE`` words have, whatever the number of partitions.
    share = min(1.0, SAMPLE / sum(r["count"] for r in sizes))
    wide = words.where(F.length("word").isin([r.k for r in sizes]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) <= int(share * (1 << 32))))
    sample = [r.word for r in wide.select("word").collect()]
    out = {}
    for r in sizes:
        own = sorted(w for w in sample if len(w) == r.k)
        if own:
            out[r.k] = Blocks(points(own), r["count"] / BLOCK_WORDS)
    return out


def _dealt(batches: Iterator[pa.RecordBatch], trees: Broadcast) -> Iterator[pa.RecordBatch]:
    """Each word once at home (kind 0), as a search for its length (1) and for the next one (2)."""
    upper = trees.value
    for batch in batches:
        if not batch.num_rows:
            continue
        words, n = batch["word"].to_pylist(), np.array(batch["n"].to_pylist(), dtype=np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = []
        for k in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == k)
            own = None
            for kind, length, up, down in ((0, k, 0, 0), (1, k, 1, 1), (2, k + 1, 1, 0)):
                tree = upper.get(length)
                if tree is None:
                    at, block = rows, np.zeros(len(rows), np.int64)
                else:
                    own = points([words[i] for i in rows]) if own is None else own
                    at, block = tree.reached(own, up, down)
                    at = rows[at]
                parts.append((at, np.full(len(at), kind), np.full(len(at), length), block))
        at, kind, length, block = (np.concatenate([p[i] for p in parts]) for i in range(4))
        taken = pa.array(at)
        arrays = [batch["word"].take(taken), pa.array(n[at]), pa.array(kind, pa.int32()), pa.array(length, pa.int64()), pa.array(block, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "kind", "length", "block"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words that have near words; ``words`` is (word, n), each word once."""
    spark = C.prepare(words.sparkSession)
    trees = spark.sparkContext.broadcast(cuts(words))
    dealt = words.mapInArrow(lambda batches: _dealt(batches, trees), "word string, n long, kind int, length long, block long")
    key = ["length", "block"]
    wanted = dealt.groupBy(*key).agg(F.count_if(F.col("kind") > 0).alias("searches"), F.count_if(F.col("kind") == 0).alias("home"))
    # Blocks without words of their own answer nothing.
    parts = wanted.where("home > 0").select(*key, F.ceil(F.greatest(F.col("searches"), F.lit(1)) / PART_SEARCHES).alias("parts")).checkpoint()
    side = F.broadcast(parts) if parts.count() <= C.MAX_BROADCAST_IDS else parts
    # Home words go to each part of their block, searches to one.
    spread = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts"))))
    placed = dealt.join(side, key).select(*key, "word", "n", "kind", F.explode(spread).alias("part"))
    found = placed.groupBy(*key, "part").applyInArrow(_searched, "word string, n_near long, less long, best string")
    best = F.min(F.struct("less", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.negative("b.less").alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word (word, n) with form, root, n_near and form_n.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent; the root is the
    last of the chain of forms, the word itself if it has none.
    """
    C.prepare(words.sparkSession)
    known = words.select("word", "n").checkpoint()
    near = near_words(known).withColumnRenamed("word", "w").checkpoint()
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = known.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    formed = formed.checkpoint()
    roots = C.tree_roots(formed.where("form IS NOT NULL").select(F.col("word").alias("u"), F.col("form").alias("v")))
    return formed.join(roots, F.col("word") == F.col("u"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
