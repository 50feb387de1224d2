"""Token counts of a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists all vocabulary pieces in a word; dynamic programming carries, for
each position, the best score, the number of pieces and whether the last one is unknown. Nothing
else of the segmentation is kept. Ties follow the tokenizer: at an end position the candidate that
starts first stays unless a later one is strictly better, an unknown character comes last, and
unknown characters in a row are one piece. Words are what the tokenizer's metaspace splitting
gives; each distinct word is counted once per worker while its table lasts.

Odd input: null and empty texts have no tokens. Other columns and repeated rows pass through.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from earshot.llm import common as C

SPACE = "▁"
#: What an unknown character's score lies below the least of the vocabulary (fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Most pieces that are sent to the workers.
MAX_PIECES = 1_000_000


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from a public piece file: its pieces, scored minus the logarithm of their rank.

    Control pieces and bytes are left out; the unknown piece is the first, as the tokenizer wants it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [("<unk>", 0.0), *[(model.id_to_piece(i), -math.log(rank + 2.0)) for rank, i in enumerate(plain)]]


class Counter:
    """Piece counts of words under a vocabulary of (piece, score); piece 0 is the unknown one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        scores = {p: s for p, s in pieces[1:] if p}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.filled = bool(scores)
        self._words: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.filled:
            for end, found in self.automaton.iter(word):
                ends[end].append(found)
        score, count, unknown = [0.0], [0], [False]
        for end in range(n):
            best = value = None
            single = False
            # Longer pieces start earlier, and the automaton lists the longer ones first.
            for length, s in ends[end]:
                candidate = s + score[end + 1 - length]
                if value is None or candidate > value:
                    best, value = end + 1 - length, candidate
                single = single or length == 1
            is_unknown = False
            if not single:
                candidate = self.unknown + score[end]
                if value is None or candidate > value:
                    best, value, is_unknown = end, candidate, True
            score.append(value)
            count.append(count[best] + (0 if is_unknown and unknown[best] else 1))
            unknown.append(is_unknown)
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        known, total = self._words, 0
        for word in marked.split(SPACE)[1:]:
            k = known.get(word)
            if k is None:
                if len(known) >= C.CACHE_WORDS:
                    known.clear()
                k = known[word] = self.pieces(SPACE + word)
            total += k
        return total


def load(spark: SparkSession, pieces: list[tuple[str, float]]) -> Broadcast:
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return spark.sparkContext.broadcast((C.fresh_name(), tuple(pieces)))


_COUNTERS: dict[str, Counter] = {}
C.worker_table(_COUNTERS.clear)


def token_counts(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens`` to the documents."""
    C.prepare(docs.sparkSession)

    def run(texts: list[bytes]) -> list[pa.Array]:
        name, pieces = vocabulary.value
        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = Counter(list(pieces))
        counter = _COUNTERS[name]
        return [pa.array([counter.count(t.decode("utf-8", "replace")) for t in texts], pa.int64())]

    return C.map_texts(docs, text_col, run, "n_tokens long", keep)
