"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with word ends marked) and itself, hashed into
rows of an embedding table; its vector is their mean, a text's vector the mean over its words, and
a softmax over two classes is put on top. Embeddings and softmax are trained together by full-batch
steps. A misspelling that was never seen shares most n-grams with its word, and so its vector.

After training, a word's share in the score is one number; workers keep them in a bounded table.

Odd input: null and empty texts have no words and get the score of the bias. Labels that are null,
repeated (the largest counts) or of unknown documents do no harm; without both classes the score is
the known class's share, or 0 without labels.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import common as C

#: Labelled documents for training, at most: this many of either class, those with the least hash of the id.
MAX_TRAIN_DOCS = 2_500
#: Bytes of their texts that are used, at most; whole documents beyond are left out.
MAX_TRAIN_BYTES = 24 << 20
BUCKETS = 1 << 17
DIMS = 4
EPOCHS = 30
#: Steps of the embeddings: their size, the floor of a row's root mean square share, and the pull to zero.
RATE, FLOOR, DECAY = 30.0, 5e-5, 1e-6
#: Averages are small (a toxic word is a few hundredths of a text), so they are scaled up.
SCALE = np.float32(20.0)
THRESHOLD = 0.7
#: Words in fewer training texts than this teach nothing, but are scored.
MIN_TEXTS = 3
MIN_ROW_TEXTS = 10

_WORD = re.compile(r"[^\W_]+")


def words(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def subwords(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words, and the word each belongs to: itself and its n-grams of 3 to 6 characters."""
    rows, owner = C.char_grams(names, range(3, 7), BUCKETS)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in names), np.int64, len(names))
    return np.concatenate([rows, whole]), np.concatenate([owner, np.arange(len(names))])


class Model:
    """Score parts of the buckets (for class 1 against class 0) and the bias."""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts, bias
        self._words: dict[str, float] = {}

    def _learn(self, names: list[str]) -> None:
        """Score parts of words that are not in the table yet."""
        rows, owner = subwords(names)
        total = np.bincount(owner, weights=self.parts[rows], minlength=len(names))
        self._words.update(zip(names, (total / np.bincount(owner, minlength=len(names))).tolist()))

    def scores(self, texts: list[bytes]) -> list[float]:
        bags = [words(t) for t in texts]
        if len(self._words) > C.CACHE_WORDS:
            self._words = {}
        missing = list(set().union(*bags).difference(self._words)) if bags else []
        for names in C.word_parts(missing):
            self._learn(names)
        part = self._words.__getitem__
        z = np.array([self.bias + (sum(map(part, bag)) / len(bag) if bag else 0.0) for bag in bags])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def score(self, text: bytes) -> float:
        return self.scores([text])[0]


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train on whole texts; ``y`` is 0 or 1 for each."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    bags = [words(t) for t in texts]
    seen: dict[str, int] = {}
    for bag in bags:
        for w in set(bag):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, k in seen.items() if k >= MIN_TEXTS))}
    # Sparse rows: document -> words with their share, word -> subwords.
    doc, word, share = [], [], []
    for d, bag in enumerate(bags):
        counts: dict[int, int] = {}
        for w in bag:
            i = vocabulary.get(w)
            if i is not None:
                counts[i] = counts.get(i, 0) + 1
        doc += [d] * len(counts)
        word += list(counts)
        share += [c / len(bag) for c in counts.values()]
    doc, word, share = np.array(doc, np.int64), np.array(word, np.int64), np.array(share, np.float32)
    n_words = len(vocabulary)
    found, owner = subwords(list(vocabulary))
    rows, sub = np.unique(found, return_inverse=True)
    weight = (1 / np.bincount(owner, minlength=n_words).astype(np.float32))[owner] if n_words else np.empty(0, np.float32)

    def gather(at, values, n):  # sum of values[:, k] over equal `at`, for each column
        return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], 1).astype(np.float32) if len(at) else np.zeros((n, values.shape[1]), np.float32)

    # Rows that few texts share hardly move, and rows with small shares move as far as those with
    # large ones: steps are divided by the row's mean square share plus a floor.
    texts_of = np.array([seen[v] for v in vocabulary], dtype=float)
    square = np.bincount(word, weights=share * share, minlength=n_words) / len(bags)
    row_square = np.bincount(sub, weights=square[owner] * weight * weight, minlength=len(rows))
    common = np.bincount(sub, weights=texts_of[owner], minlength=len(rows)) >= MIN_ROW_TEXTS
    step = (common / (np.sqrt(row_square) + FLOOR) ** 2)[:, None].astype(np.float32) if len(rows) else np.zeros((0, 1), np.float32)
    if len(rows):
        step /= 1 / (np.quantile(np.sqrt(row_square), 0.99) + FLOOR) ** 2
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (len(rows), DIMS)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    w[:, 0] = -w[:, 1]
    b = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[y.astype(int)]
    # Either class has half of the weight.
    share_of_doc = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)[:, None]
    momentum = np.zeros_like(e)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    n_docs = len(bags)
    for t in range(1, epochs + 1):
        word_vec = gather(owner, e[sub] * weight[:, None], n_words)
        doc_vec = gather(doc, word_vec[word] * share[:, None], n_docs) * SCALE
        z = doc_vec @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * share_of_doc
        g_doc = (g @ w.T) * SCALE
        g_word = gather(word, g_doc[doc] * share[:, None], n_words)
        momentum = 0.9 * momentum + gather(sub, g_word[owner] * weight[:, None], len(rows)) + DECAY * e
        g_w, g_b = doc_vec.T @ g + 1e-4 * w, g.sum(0)
        e -= RATE * step * momentum
        for (m, v), param, grad in zip(moments, (w, b), (g_w, g_b)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    parts = np.zeros(BUCKETS, np.float32)
    parts[rows] = (e @ (w[:, 1] - w[:, 0])) * SCALE
    return Model(parts, float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled documents."""
    C.prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sample = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN_DOCS).union(known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN_DOCS))
    rows = docs.select(F.col(id_col).alias("id"), C.utf8(text_col).alias("text")).join(F.broadcast(sample), "id").dropDuplicates(["id"])
    # Sizes first, so that no more than MAX_TRAIN_BYTES of text come to the driver.
    sizes = rows.select("id", F.length("text").alias("size")).orderBy(F.xxhash64("id"), "id").limit(2 * MAX_TRAIN_DOCS).collect()
    total, chosen = 0, []
    for r in sizes:
        if total + r.size <= MAX_TRAIN_BYTES:
            total += r.size
            chosen.append(r.id)
    got = rows.where(F.col("id").isin(chosen)).orderBy("id").collect() if chosen else []
    return train([bytes(r.text) for r in got], np.array([r.y for r in got], dtype=float))


@lru_cache(maxsize=2)
def _model(packed: bytes, bias: float) -> Model:
    return Model(np.frombuffer(packed, np.float32), bias)


C.worker_table(_model.cache_clear)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    C.prepare(docs.sparkSession)
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast((model.parts.tobytes(), model.bias))

    def run(texts: list[bytes]) -> list[pa.Array]:
        own = _model(*sent.value)
        values = own.scores(texts)
        return [pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32())]

    return C.map_texts(docs, text_col, run, "score double, predicted int", keep)
