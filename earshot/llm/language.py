"""Language of texts and of their spans.

Words are runs of letters of one script, which narrows a word's candidates to the languages that use
it. Each word has a score for each candidate (naive Bayes over its character n-grams, learned from
labelled texts); its evidence is bounded, in scripts without spaces in proportion to its length. A
Viterbi pass with a penalty for switching labels the words. Runs of one label are the spans; a
document's language is the one with the most letters.

A text is one span of its best language without a walk if no stretch of words favours another
language by more than the penalty, nor a start and an end of it together: leaving the best language
and coming back costs two penalties, and labels without it one less than they have stretches, of
which only the first and the last need no gain of their own. Other texts are walked word by word.

Odd input: a null text or one without a letter is ``und`` with score 0 and has no span, and so is
any text when no label is known. Ties go to the language that is first in order.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import common as C

#: Labelled documents of each language that are learned from, at most (least hash of the id), and
#: the bytes of their texts in all; documents beyond either are left out whole.
MAX_TRAIN_DOCS = 400
MAX_TRAIN_BYTES = 48 << 20
#: Log-odds that a change of language must gain.
SWITCH = 10.0
#: Most that the n-grams of one word can say against a language.
WORD_LIMIT = 6.0
#: What a word says against languages that do not use its script: more than any switches gain.
OTHER_SCRIPT = 1000.0
#: Scripts without spaces, and the letters that weigh as much as a word there.
UNSPACED = {"Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Myanmar", "Khmer", "Tibetan"}
UNSPACED_LETTERS = 4
UNKNOWN = "und"

#: First code points of ranges and their scripts (fixed values of Unicode, by block).
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
    (0x20000, "Han"), (0x30000, "Other"),
]
_STARTS = [start for start, _ in RANGES]
_WORD = re.compile(r"[^\W\d_]+")
_BEYOND_LATIN = re.compile("[^\u0000-\u036f\u1e00-\u1eff]")
_ORDERS = range(1, 5)
#: Rows of the table of hashed n-grams.
BUCKETS = 1 << 18


@lru_cache(maxsize=1 << 16)
def script(letter: str) -> str:
    return RANGES[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


C.worker_table(script.cache_clear)


def split_word(word: str) -> list[str]:
    """A run of letters, cut where the script changes."""
    return [word] if not _BEYOND_LATIN.search(word) else ["".join(run) for _, run in groupby(word, script)]


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text)
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return found
    return [w for run in found for w in split_word(run)]


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of ``words_of``."""
    out = []
    for m in _WORD.finditer(text):
        start = m.start()
        for w in split_word(m.group()):
            out.append((start, start + len(w)))
            start += len(w)
    return out


class Model:
    """Scaled log-probabilities of hashed n-grams for each language, and the scripts each one uses."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.table, self.scripts = langs, table, scripts
        self._start()

    def _start(self) -> None:
        self._row: dict[str, int] = {}
        self._scores = np.zeros((4096, len(self.langs)), dtype=np.float64)

    def __getstate__(self):
        return (self.langs, self.table, self.scripts)

    def __setstate__(self, state):
        self.langs, self.table, self.scripts = state
        self._start()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of lower-cased words for each language, 0 for a word's best one."""
        rows, owner = C.char_grams(words, _ORDERS, BUCKETS)
        total = np.stack([np.bincount(owner, weights=self.table[rows, k], minlength=len(words)) for k in range(len(self.langs))], 1)
        # Rows of the scripts' table: 0 for scripts that no language uses.
        number = {name: i for i, name in enumerate(self.scripts, 1)}
        allowed = np.stack([np.ones(len(self.langs), dtype=bool), *[v if v.any() else np.ones(len(self.langs), dtype=bool) for v in self.scripts.values()]])
        usable = np.array([False, *[bool(v.any()) for v in self.scripts.values()]])
        letters = {c: number.get(script(c), 0) for c in {w[0] for w in words}}
        used = np.fromiter((letters[w[0]] for w in words), np.int64, len(words))
        known = usable[used]
        own = allowed[used]
        total -= np.where(own, total, -np.inf).max(1, keepdims=True)
        unspaced = np.array([False, *[name in UNSPACED for name in self.scripts]])[used]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        limit = WORD_LIMIT * np.where(unspaced, np.maximum(sizes / UNSPACED_LETTERS, 1.0), 1.0)
        total = np.where(own, np.maximum(total, -limit[:, None]), -OTHER_SCRIPT)
        return np.where(known[:, None], total, 0.0)

    def learn(self, words: set[str]) -> None:
        """Take the scores of words into the table."""
        new = sorted(words.difference(self._row))
        for part in C.word_parts(new):
            first = len(self._row)
            while first + len(part) > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._scores[first : first + len(part)] = self.word_scores(part)
            self._row.update(zip(part, range(first, first + len(part))))

    def batch(self, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], str, float]]:
        """``spans`` of many texts: all their new words are scored at once, in a table that starts anew when full."""
        if len(self._row) > C.CACHE_WORDS:
            self._start()
        words = [words_of(t) for t in texts]
        lowered = [list(map(str.lower, ws)) for ws in words]
        if self.langs:
            self.learn(set().union(*lowered))
        return [self._spans(*x) for x in zip(texts, words, lowered)]

    def _rows(self, words: list[str]) -> np.ndarray:
        return self._scores[list(map(self._row.__getitem__, words))]

    def label(self, words: list[str]) -> np.ndarray:
        """Language number of each lower-cased word."""
        s = self._rows(words)
        best = int(s.sum(0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
        start = np.vstack([np.zeros((1, s.shape[1])), low[:-1]])
        ends = max(gain.max(), 0.0) + (gain[-1] - low[-1]).max()
        if (gain - start).max() <= SWITCH and ends <= SWITCH:
            return np.full(len(words), best)
        return viterbi(s)

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], str, float]:
        """Spans (start, end, language) in characters, the text's language and its share of the letters."""
        return self.batch([text])[0]

    def _spans(self, text: str, words: list[str], lowered: list[str]) -> tuple[list[tuple[int, int, str]], str, float]:
        if not words or not self.langs:
            return [], UNKNOWN, 0.0
        labels = self.label(lowered)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.bincount(labels, weights=sizes, minlength=len(self.langs))
        top = int(letters.argmax())
        edge = np.flatnonzero(np.diff(labels)) + 1
        bounds = [0, *edge.tolist(), len(words)]
        if len(bounds) == 2:
            first = text.find(words[0])
            spans = [(first, text.rfind(words[-1]) + len(words[-1]), self.langs[labels[0]])]
        else:
            at = places(text)
            spans = [(at[i][0], at[j - 1][1], self.langs[labels[i]]) for i, j in zip(bounds, bounds[1:])]
        return spans, self.langs[top], float(letters[top] / letters.sum())


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of rows of scores when each change of label costs ``switch``."""
    rows = scores.tolist()
    value = rows[0]
    back: list[tuple[int, list[bool]]] = []
    for row in rows[1:]:
        top = max(value)
        jump = top - switch
        back.append((value.index(top), [v < jump for v in value]))
        value = [(v if v >= jump else jump) + x for v, x in zip(value, row)]
    k = value.index(max(value))
    out = [k]
    for best, jumped in reversed(back):
        if jumped[k]:
            k = best
        out.append(k)
    return np.array(out[::-1])


def train(samples: list[tuple[str, str]]) -> Model:
    """Learn from (language, text) pairs."""
    langs = sorted({lang for lang, _ in samples})
    counts = np.zeros((len(_ORDERS), BUCKETS, len(langs)))
    letters: dict[str, np.ndarray] = {}
    for i, lang in enumerate(langs):
        forms: dict[str, int] = {}
        for own, text in samples:
            if own == lang:
                for w in words_of(text):
                    w = w.lower()
                    forms[w] = forms.get(w, 0) + 1
        for w, k in forms.items():
            letters.setdefault(script(w[0]), np.zeros(len(langs)))[i] += k * len(w)
        for names in C.word_parts(list(forms)):
            times = np.array([forms[w] for w in names], dtype=float)
            for j, n in enumerate(_ORDERS):
                rows, owner = C.char_grams(names, range(n, n + 1), BUCKETS)
                counts[j, :, i] += np.bincount(rows, weights=times[owner], minlength=BUCKETS)
    # Each bucket's score is the sum over the orders that use it; nothing is known where none does.
    table = np.zeros((BUCKETS, len(langs)))
    for c in counts:
        seen = c.any(axis=1)
        share = np.log((c[seen] + 0.5) / (c.sum(0) + 0.5 * (seen.sum() + 1)))
        # Scaled down, as overlapping n-grams repeat each other's evidence.
        table[seen] += share / len(_ORDERS)
    whole = sum(letters.values()) if letters else np.ones(len(langs))
    scripts = {name: v >= 0.01 * np.maximum(whole, 1) for name, v in letters.items()}
    return Model(langs, table, scripts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of each language's documents."""
    C.prepare(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.octet_length(C.utf8(text_col)).alias("size")).where("lang IS NOT NULL AND id IS NOT NULL")
    # Rows of one id and language count once.
    known = known.groupBy("id", "lang").agg(F.max("size").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= MAX_TRAIN_DOCS).orderBy("k", "lang").collect()
    total, keys = 0, []
    for r in chosen:
        if total + r.size <= MAX_TRAIN_BYTES:
            total += r.size
            keys.append((r.id, r.lang))
    if not keys:
        return Model([], np.zeros((BUCKETS, 0)), {})
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "w long, l string"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), C.utf8(text_col).alias("text"))
    rows = rows.join(wanted, (F.col("id") == F.col("w")) & (F.col("lang") == F.col("l")), "left_semi")
    got = rows.groupBy("id", "lang").agg(F.min("text").alias("text")).orderBy("id", "lang").collect()
    return train([(r.lang, bytes(r.text).decode("utf-8", "replace")) for r in got])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (its share of the letters) and ``lang_spans`` to the documents."""
    C.prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(texts: list[bytes]) -> list[pa.Array]:
        made = sent.value.batch([t.decode("utf-8", "replace") for t in texts])
        spans = [[{"start": a, "end": b, "lang": c} for a, b, c in m[0]] for m in made]
        return [pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.float64()), pa.array(spans, kind)]

    fields = "lang_pred string, score double, lang_spans array<struct<start: long, end: long, lang: string>>"
    return C.map_texts(docs, text_col, run, fields, keep)
