"""Text columns: normalising, keys, language, term matching and lexicon scores.

Everything is a built-in expression but the Unicode folding (compatibility form plus full case
folding), which Spark has no function for. That one runs as an Arrow batch function, and only
non-ASCII values are shipped to Python: for ASCII text ``lower`` gives the same answer.
"""

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot import config
from earshot.functions import word_lists

# Runs of whitespace that are not one space already: most words are parted by one, which stays as it is.
_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
_LINK = r"(?U)https?://[^\s\x1c-\x1f]+"
_HANDLE = r"(?U)@\w+"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(T.StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


def fold(text) -> Column:
    """Compatibility form, then full case folding."""
    text = _col(text)
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold_unicode(F.when(wide, text)), F.lower(text))


def squeeze(text) -> Column:
    """Whitespace runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(_col(text), _SPACE, " "))


def normalize(text) -> Column:
    """F01. Fold, then drop links, then handles, then collapse whitespace, in that order."""
    bare = F.regexp_replace(fold(text), _LINK, "")
    return squeeze(F.regexp_replace(bare, _HANDLE, ""))


def normalize_term(text) -> Column:
    """F36. Fold and collapse whitespace; links and handles stay."""
    return squeeze(fold(text))


def normalize_literal(value: str) -> str:
    """F01 for one driver-side string, such as a brand name or a lexicon term."""
    value = unicodedata.normalize("NFKC", value).casefold()
    value = re.sub(r"https?://\S+", "", value)
    value = re.sub(r"@\w+", "", value)
    return " ".join(value.split())


def text_key(text, normalized: bool = False) -> Column:
    """F03. First 200 characters of the normalised text."""
    base = _col(text) if normalized else normalize(text)
    return F.substring(base, 1, config.TEXT_KEY_CHARS)


def normalize_url(url) -> Column:
    """F02. Lower scheme and host, no trailing slash, no tracking keys, no fragment."""
    url = _col(url)
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    host = F.lower(F.regexp_extract(url, pattern, 2))
    whole_path = F.regexp_extract(url, pattern, 3)
    path = F.regexp_replace(F.regexp_replace(whole_path, r";[^/]*$", ""), r"/+$", "")
    params = F.regexp_extract(whole_path, r"(;[^/]*)$", 1)
    query = F.regexp_extract(url, pattern, 4)

    def decoded(raw):
        return F.coalesce(F.try_url_decode(raw), raw)

    def encoded(value):
        return F.replace(
            F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
        )

    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda part: part != ""),
        lambda part: F.struct(
            decoded(F.regexp_extract(part, r"^([^=]*)", 1)).alias("name"),
            decoded(F.regexp_extract(part, r"^[^=]*=(?s:(.*))$", 1)).alias("value"),
        ),
    )
    wanted = F.filter(
        pairs, lambda pair: ~F.lower(pair["name"]).isin(*config.TRACKING_PARAMS)
    )
    grouped = F.flatten(
        F.transform(
            F.array_distinct(F.transform(wanted, lambda pair: pair["name"])),
            lambda name: F.filter(wanted, lambda pair: pair["name"] == name),
        )
    )
    query_out = F.array_join(
        F.transform(
            grouped,
            lambda pair: F.concat(encoded(pair["name"]), F.lit("="), encoded(pair["value"])),
        ),
        "&",
    )
    return F.when(
        url.isNotNull(),
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            host,
            F.when(path == "", F.lit("/")).otherwise(path),
            params,
            F.when(query_out != "", F.concat(F.lit("?"), query_out)).otherwise(""),
        ),
    )


def detect_lang(text, normalized: bool = False) -> Column:
    """F07. pt, en, other or unknown, by the share of stop words."""
    base = _col(text) if normalized else normalize(text)

    def hits(words, stop):
        # A long list of literals becomes a hash set.
        return F.size(F.filter(words, lambda word: word.isin(*stop)))

    def count(words):
        return F.struct(
            F.size(words).alias("n"),
            hits(words, word_lists.STOP_PT).alias("pt"),
            hits(words, word_lists.STOP_EN).alias("en"),
        )

    def decide(c):
        pt = c["pt"] / c["n"] > 0.10
        en = c["en"] / c["n"] > 0.10
        return (
            F.when(c["n"].isNull(), None)
            .when(c["n"] < 5, "unknown")
            .when(pt & en & (c["pt"] >= 2 * c["en"]), "pt")
            .when(pt & en & (c["en"] >= 2 * c["pt"]), "en")
            .when(pt & en, "other")
            .when(pt, "pt")
            .when(en, "en")
            .otherwise("other")
        )

    words = F.regexp_extract_all(base, F.lit(r"([a-zà-ú]+)"), F.lit(1))
    return let(let(words, count), decide)


def match_terms(text, terms: Sequence[str], normalized: bool = False) -> Column:
    """F08. Normalised terms found at word boundaries, first hit first, each once.

    The alternatives keep the order given.
    """
    base = _col(text) if normalized else normalize(text)
    if not terms:
        return F.array().cast("array<string>")
    literals = [normalize_literal(term) for term in terms]
    options = "|".join(re.escape(term) for term in literals)
    # Most places begin no term, which its first character tells before the boundary is looked for.
    begins = "" if "" in literals else "(?=[" + "".join(sorted({re.escape(term[0]) for term in literals})) + "])"
    pattern = rf"(?iU){begins}(?:^|(?<=\s)|\b)({options})(?:\s|$|\b)"
    return F.array_distinct(F.regexp_extract_all(base, F.lit(pattern), F.lit(1)))


def lexicon_pattern(terms: Sequence[str]) -> str:
    """Longest-first alternation between non-word characters.

    Terms are grouped by first character, so a position tries only the terms that can start
    there; within a group the longest comes first, which is the same preference.
    """
    groups: dict[str, list[str]] = {}
    for term in sorted(terms, key=lambda term: (-len(term), term)):
        groups.setdefault(term[0], []).append(term)
    parts = [
        re.escape(first) + "(?:" + "|".join(re.escape(term[1:]) for term in group) + ")"
        for first, group in sorted(groups.items())
    ]
    return r"(?U)((?<!\w)(?:" + "|".join(parts) + r")(?!\w))"


def lexicon_score(
    text, lexicon: Mapping[str, int] | None = None, normalized: bool = False
) -> Column:
    """F09. Struct of hits, n_hits, score and sign (null when the score is 0)."""
    base = _col(text) if normalized else normalize(text)
    table = {
        normalize_literal(term): polarity
        for term, polarity in (lexicon or word_lists.sentiment_terms()).items()
    }
    if not table or "" in table:
        raise ValueError("a lexicon needs at least one term, and no empty ones")
    pattern = F.lit(lexicon_pattern(list(table)))
    positive = sorted(term for term, polarity in table.items() if polarity > 0)
    up = lambda found: F.size(F.filter(found, lambda term: term.isin(*positive)))

    def scored(found):
        def summed(c):
            return F.struct(
                found.alias("hits"),
                c["n"].alias("n_hits"),
                c["score"].alias("score"),
                F.when(c["score"] > 0, "positive").when(c["score"] < 0, "negative").alias("sign"),
            )

        n = F.size(found).cast("long")
        counts = F.struct(n.alias("n"), (2 * up(found) - n).cast("long").alias("score"))
        return F.when(found.isNotNull(), let(counts, summed))

    return let(F.regexp_extract_all(base, pattern, F.lit(1)), scored)


def rating_bucket(rating) -> Column:
    """F10."""
    rating = _col(rating)
    return (
        F.when(rating <= config.RATING_NEGATIVE_MAX, "negative")
        .when(rating >= config.RATING_POSITIVE_MIN, "positive")
        .when(rating.isNotNull(), "neutral")
    )


def deterministic_signal(source, rating, text, lexicon=None, normalized: bool = False) -> Column:
    """F11. Rating bucket on review sources with a rating, else the sign of the lexicon."""
    source, rating = _col(source), _col(rating)
    rated = source.isin(*config.REVIEW_SOURCES) & rating.isNotNull()

    def signal(score):
        return F.struct(
            F.when(rated, "rating")
            .when(score["n_hits"] > 0, "lexicon")
            .otherwise("none")
            .alias("kind"),
            F.when(rated, rating_bucket(rating)).otherwise(score["sign"]).alias("label"),
        )

    return let(lexicon_score(text, lexicon, normalized), signal)


def quote(text) -> Column:
    """F17. Verbatim first 240 characters."""
    return F.substring(_col(text), 1, config.QUOTE_CHARS)


def first_words(text, n: int) -> Column:
    """F18. The first ``n`` whitespace-separated words, single-spaced."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def clip_rationale(text) -> Column:
    """F18. At most 20 words and 200 characters; a shorter text keeps its own spacing."""
    text = _col(text)
    n_words = F.when(squeeze(text) == "", 0).otherwise(F.size(F.split(squeeze(text), " ")))
    kept = F.when(n_words > config.RATIONALE_WORDS, first_words(text, config.RATIONALE_WORDS))
    return F.substring(kept.otherwise(text), 1, config.RATIONALE_CHARS)


def cap_words(text, n: int = config.TOPIC_NAME_WORDS) -> Column:
    """F18. A model's topic name: outer quotes and full stops off, at most ``n`` words."""
    edge = r"(?U)^[\s\"'.]+|[\s\"'.]+$"
    inner = F.regexp_replace(_col(text), edge, "")
    return F.regexp_replace(first_words(inner, n), edge, "")


def brand_slug(brand: str) -> str:
    """F14. ASCII slug of a brand name, on the driver: brands are a short list."""
    ascii_only = unicodedata.normalize("NFKD", brand).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^0-9a-z]+", "-", ascii_only.casefold()).strip("-") or "brand"


def token_set(text, normalized: bool = False) -> Column:
    """Distinct tokens of three characters or more, for lexical ranking."""
    base = _col(text) if normalized else normalize(text)
    return F.array_distinct(
        F.filter(F.split(base, " "), lambda w: F.char_length(w) >= config.MIN_TOKEN_CHARS)
    )


def redact(text, secrets: Sequence[str] = ()) -> Column:
    """F25. Known secrets, then secret-looking values, replaced by a mask."""
    out = _col(text)
    for secret in secrets:
        if len(secret) >= config.MIN_SECRET_CHARS:
            out = F.replace(out, F.lit(secret), F.lit(config.REDACTED))
    for pattern in config.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, config.REDACTED)
    return out


def redact_map(values, secrets: Sequence[str] = ()) -> Column:
    """F25 for a string map: values under secret-looking names are blanked, others redacted."""
    return F.transform_values(
        _col(values),
        lambda name, value: F.when(
            name.rlike(config.SECRET_KEY_PATTERN), F.lit(config.REDACTED)
        ).otherwise(redact(value, secrets)),
    )
