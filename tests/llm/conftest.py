import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tru", "sen") for b in ("ra", "den", "vo", "st") for c in ("", "n", "ti", "mor", "el")]


@pytest.fixture
def prose():
    """prose(seed, n): n words that depend on the seed alone."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, names that clash."""

    def make(rows=None, columns="doc_id long, text string, lang string, source string, n_chars long"):
        clashes = ", id string, row string, h long, size string, spans string, score string, shard string, node string, key string, n_words string, token_ids string, fingerprint string, evidence string, `a.b` string"
        rows = rows if rows is not None else [
            (1, "one two three four five six seven", "en", "s1", 33),
            (1, "one two three four five six seven", "en", "s1", 33),
            (2, None, None, None, None),
            (3, "", "en", "s1", 0),
            (4, " \n\t ", "de", None, 4),
            (None, "one two three four five six seven", None, "s2", None),
            (None, None, "en", "s1", None),
            (5, "word " * 30_000, "en", "s1", 150_000),
            (6, "漢字 слово \U0001f600 déjà", "fr", "s1", 12),
        ]
        width = clashes.count(",")
        return spark.createDataFrame([(*r, *[None] * width) for r in rows], columns + clashes)

    return make
