from pyspark.sql import functions as F

from earshot.functions import numbers as N
from earshot.functions import scalars as S
from earshot.functions import text as X


def values(spark, rows, expression, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_normalize_order_and_unicode(spark):
    rows = ["  Olá @Fulano  veja https://x.y/z?q=1 AGORA", "ﬁne ＡＢＣ", "STRASSE ß", "", None, "a\x1cb c"]
    assert values(spark, rows, X.normalize) == [
        "olá veja agora", "fine abc", "strasse ss", "", None, "a b c",
    ]


def test_text_key_is_two_hundred_characters(spark):
    assert values(spark, ["x" * 300, "É" * 3], X.text_key) == ["x" * 200, "ééé"]


def test_normalize_url(spark):
    cases = {
        "HTTPS://Example.COM/Path/?utm_source=a&b=2&B=1&b=3#frag": "https://example.com/Path?b=2&b=3&B=1",
        "http://h.example": "http://h.example/",
        "http://h.example/a//": "http://h.example/a",
        "http://h.example/?q=a+b%20c~*&e=": "http://h.example/?q=a+b+c~%2A&e=",
        "http://h.example/p;v=1?FBCLID=9": "http://h.example/p;v=1",
        "/only/path?x": "/only/path?x=",
    }
    assert values(spark, list(cases), X.normalize_url) == list(cases.values())
    assert values(spark, [None], X.normalize_url) == [None]


def test_detect_lang(spark):
    rows = [
        "não gostei do aplicativo porque ele trava", "the app is not what you want from them", "um dois",
        "lorem ipsum dolor sit amet consectetur", None, "a do no a do no xx yy zz ww",
    ]
    assert values(spark, rows, X.detect_lang) == ["pt", "en", "unknown", "other", None, "other"]


def test_match_terms_needs_word_boundaries(spark):
    terms = ["Banco", "Banco Inter", "inter", "nu"]
    rows = ["O banco inter na internet, INTER!", "nu, nubank e nu nu", "nada", None]
    # The alternatives keep their order: the shorter term comes first here and wins.
    want = [["banco", "inter"], ["nu"], [], None]
    assert values(spark, rows, lambda c: X.match_terms(c, terms)) == want
    assert values(spark, ["x"], lambda c: X.match_terms(c, [])) == [[]]


def test_lexicon_takes_the_longest_phrase_once(spark):
    score = lambda c: X.lexicon_score(c)
    got = values(spark, ["Não recomendo, péssimo", "ótimo! recomendo", "good bad", "zzz", "notgood"], score)
    assert [r["hits"] for r in got] == [
        ["não recomendo", "péssimo"], ["ótimo", "recomendo"], ["good", "bad"], [], [],
    ]
    assert [(r["n_hits"], r["score"], r["sign"]) for r in got] == [
        (2, -2, "negative"), (2, 2, "positive"), (2, 0, None), (0, 0, None), (0, 0, None),
    ]


def test_deterministic_signal(spark):
    rows = [("g2", 1, "great"), ("g2", None, "great"), ("news", 5, "bad"), ("g2", 3, ""), ("news", None, "good bad")]
    df = spark.createDataFrame(rows, "s string, r int, t string")
    got = [tuple(r[0]) for r in df.select(X.deterministic_signal("s", "r", "t")).collect()]
    assert got == [
        ("rating", "negative"), ("lexicon", "positive"), ("lexicon", "negative"), ("rating", "neutral"),
        ("lexicon", None),
    ]


def test_clip_and_cap(spark):
    long = " ".join(f"w{i}" for i in range(25))
    assert values(spark, [long, "a  b", ""], X.clip_rationale) == [" ".join(long.split()[:20]), "a  b", ""]
    assert values(spark, ['"One two three four five six seven."'], X.cap_words) == ["One two three four five six"]


def test_brand_slug():
    assert X.brand_slug("Itaú Unibanco") == "itau-unibanco"
    assert X.brand_slug("漢字") == "brand"


def test_redact(spark):
    rows = ["key sk-" + "a" * 24 + " end", "Bearer abcdefgh1", "hush my-secret", None]
    got = values(spark, rows, lambda c: X.redact(c, ["my-secret"]))
    assert got == ["key [REDACTED] end", "[REDACTED]", "hush [REDACTED]", None]


def test_numbers(spark):
    text = "$1,234.50 then -3% and 12 per cent, v2.0 x7 on 2024-01-05 [" + "a" * 24 + "] 007"
    got = values(spark, [text], lambda c: N.extract_numbers(N.clean_for_numbers(c)))[0]
    assert [(t["text"], float(t["value"]), t["percent"], t["decimals"]) for t in got] == [
        ("$1,234.50", 1234.5, False, 2), ("-3%", -3.0, True, 0), ("12 per cent", 12.0, True, 0),
        ("007", 7.0, False, 0),
    ]
    spoken = values(spark, ["minus 0.27 of 5 pct"], lambda c: N.extract_numbers(c, True))[0]
    assert [(float(t["value"]), t["percent"]) for t in spoken] == [(-0.27, False), (5.0, True)]


def test_strip_citations(spark):
    df = spark.createDataFrame([("See [ ab.c ] here ab.c .", ["ab.c"]), ("x  y", [])], "t string, u array<string>")
    assert [r[0] for r in df.select(N.strip_citations("t", "u")).collect()] == ["See here.", "x y"]


def test_parse_timestamp(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "1704164645", "1704164645000", "2024-01-02T03:04:05-02:00", "soon", None]
    got = values(spark, rows, lambda c: F.unix_timestamp(S.parse_timestamp(c)))
    assert got == [1704164645, 1704164645, 1704164645, 1704164645, 1704171845, None, None]


def test_half_up_and_digest(spark):
    df = spark.createDataFrame([("0.125",), ("2.5",)], "v string").select(F.col("v").cast("decimal(10,4)").alias("v"))
    assert [float(r[0]) for r in df.select(S.round_half_up("v", 2)).collect()] == [0.13, 2.5]
    import hashlib
    import json

    body = {"a": 1, "b": {"c": None, "d": "é"}}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:24]
    inner = F.struct(F.lit(None).cast("string").alias("c"), F.lit("é").alias("d"))
    got = df.select(S.input_digest(F.struct(F.lit(1).alias("a"), inner.alias("b")))).first()[0]
    assert got == want


def test_runs_of_any_whitespace_and_terms_at_any_place(spark):
    import random
    import re

    rng = random.Random(5)
    parts = ["a", "I", "the", "@x", " ", "  ", "\t", "\n ", " \u00a0", "\u2003", "\x1c", "\x1f ", "\u00e9", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = ["the", "i", "a.", "x", "\u00e9 a"]
    options = "|".join(re.escape(t) for t in terms)
    plain = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?iU)(?:^|(?<=\s)|\b)({options})(?:\s|$|\b)"), F.lit(1)))
    every = F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))
    got = rows.select("text", X.squeeze("text").alias("s"), every.alias("s2"), X.match_terms("text", terms, normalized=True).alias("m"), plain.alias("m2")).collect()
    assert all(r["s"] == r["s2"] and r["m"] == r["m2"] for r in got) and sum(len(r["m"]) > 0 for r in got) > 100
