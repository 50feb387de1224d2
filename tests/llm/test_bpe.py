import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from earshot.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


CASES = ["", "a", " ", "  ", "\n", "a  b", "a \n b", "a\n\nb ", "<|endoftext|>", "x<|endoftext|> y", " 's 't", "x" * 5000, "ab" * 4000, "é" * 300, "zq" * 100, "tblé\n\xa0", "\x1c a\x85b"]


def test_same_ids_as_the_tokenizer(codec):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = [*"abcdeilnrst'sdm  \n\t\r\x0b\x1c\x1f\x85\xa0　 ​ ﻿,.!0123éñ漢字\U0001f600́<|>A", "<|endoftext|>", "'ll", " 's", "aaaa", "   ", "\x00"]
    cases = CASES + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text.encode())
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert codec.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_tables_start_anew_when_full(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    text = " ".join(f"word{i}, other{i}" for i in range(50))
    again = codec.encode(text.encode())
    assert codec.decode(again) == text


def test_forced_boundaries_are_never_inside_a_token(codec):
    for token in list(codec.tokens.values())[:-1]:
        assert len(codec.fragments(token)) == 1
    assert len(codec.fragments("é漢xé".encode())) > 1


def test_rows(spark, odd_docs):
    vocabulary = bpe.load(spark, PATH)
    docs = odd_docs()
    for packed in (False, True):
        ids = bpe.encode(docs, vocabulary, packed=packed)
        assert set(docs.columns) <= set(ids.columns)
        back = bpe.decode(ids, vocabulary).collect()
        assert len(back) == docs.count()
        assert all(r.decoded == (r.text or "") for r in back)
        assert all(r.n_tokens == 0 for r in back if not r.text)
    assert bpe.decode(bpe.encode(docs.limit(0), vocabulary), vocabulary).count() == 0
