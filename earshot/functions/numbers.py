"""Numbers written in text, and how a written number may match a known value.

A value is a text in plain decimal form: a minus sign if it is below zero, digits without leading zeros,
and a fraction without trailing zeros, if there is one. Equal numbers have equal texts, whatever their
length, and are rounded digit by digit.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import _col, let

_MARKER = r"\[\s*[0-9a-f]{24}\s*\]"
_HEX24 = r"(?<![0-9a-zA-Z])[0-9a-f]{24}(?![0-9a-zA-Z])"
_ISO = r"(?U)\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?\b"
# Groups: sign, dollar, digits, fraction, percent; then the variant that knows the word "minus".
_AMOUNT = r"(\$)?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?\s?"
_WRITTEN = r"((?<![\w.])(?:[-−–])?" + _AMOUNT + r"(?:%|percent\b|per\s?cent\b|pct\b)?)"
_SPOKEN = (
    r"((?:\bminus\s+|(?<![0-9.])[-−–])?" + _AMOUNT + r"(?:%|(?:percent|per\s?cent|pct)\b)?)"
)
# The parts of one number already found.
_PARTS = r"(?iU)^(minus\s+|[-−–])?(?:\$)?([0-9,]+)(\.[0-9]+)?\s?(\D.*)?$"


def clean_for_numbers(text) -> Column:
    """Citation markers, bare mention ids and ISO dates replaced by a space."""
    out = _col(text)
    for pattern in (_MARKER, _HEX24, _ISO):
        out = F.regexp_replace(out, pattern, " ")
    return out


def _clean(text: Column) -> Column:
    """The plain form of signed digits with a point somewhere."""
    out = F.regexp_replace(text, r"^(-?)0*(?=[0-9])", "$1")
    out = F.regexp_replace(out, r"^(-?)\.", "$10.")
    out = F.regexp_replace(F.regexp_replace(out, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(out, r"^-0$", "0")


def plain(negative: Column, whole: Column, fraction: Column) -> Column:
    """The plain form of the digits before and after the point."""
    return _clean(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), fraction))


def _zeros(n: Column) -> Column:
    return F.repeat(F.lit("0"), n)


def _shifted(parts: Column) -> Column:
    """Digits {sign, whole, fraction, power} with the point moved by the exponent."""

    def moved(c):
        return F.concat(c["sign"], F.left(c["digits"], c["point"]), F.lit("."), F.substr(c["digits"], c["point"] + 1))

    def widened(c):
        # Zeros on either side, so that the point is always among the digits.
        before, after = F.greatest(-c["power"], F.lit(0)), F.greatest(c["power"], F.lit(0))
        digits = F.concat(_zeros(before), c["whole"], c["fraction"], _zeros(after))
        return F.struct(c["sign"].alias("sign"), digits.alias("digits"), (F.char_length(c["whole"]) + before + c["power"]).alias("point"))

    return let(let(parts, widened), moved)


def number_text(value) -> Column:
    """The plain form of a number of any type, or of its text, also with an exponent; null for other text."""
    text = F.trim(_col(value).cast("string"))
    pattern = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,4}))?$"

    def form(t):
        part = lambda i: F.regexp_extract(t, pattern, i)
        sign = F.when(part(1) == "-", F.lit("-")).otherwise(F.lit(""))
        power = F.coalesce(part(4).try_cast("int"), F.lit(0))
        scientific = _shifted(F.struct(sign.alias("sign"), part(2).alias("whole"), part(3).alias("fraction"), power.alias("power")))
        simple = F.concat(F.regexp_replace(t, r"^\+", ""), F.when(F.contains(t, F.lit(".")), F.lit("")).otherwise(F.lit(".")))
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), simple).when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]{1,4}$"), scientific)

    return _clean(let(text, form))


_FRACTION = r"\.([0-9]*)$"


def places_of(value: Column) -> Column:
    """Digits after the point of a value in plain form."""
    return F.char_length(F.regexp_extract(value, _FRACTION, 1))


def rounded(value: Column, places: Column) -> Column:
    """A value in plain form rounded half up (away from zero) to fewer places than it has."""

    def cut(c):
        whole = F.regexp_extract(c["value"], "^-?([0-9]*)", 1)
        fraction = F.regexp_extract(c["value"], _FRACTION, 1)
        kept = F.concat(whole, F.left(fraction, c["places"]))
        return F.struct(
            F.startswith(c["value"], F.lit("-")).alias("negative"), kept.alias("kept"), F.rtrim(kept, F.lit("9")).alias("stem"),
            (F.substr(fraction, c["places"] + 1, F.lit(1)) >= "5").alias("up"), c["places"].alias("places"),
        )

    def carried(c):
        # Add one to the last digit that is no nine; the nines behind it become zeros.
        last = F.translate(F.right(c["stem"], F.lit(1)), "012345678", "123456789")
        more = F.concat(F.left(c["stem"], F.char_length(c["stem"]) - 1), last)
        nines = _zeros(F.char_length(c["kept"]) - F.char_length(c["stem"]))
        raised = F.concat(F.when(c["stem"] == "", F.lit("1")).otherwise(more), nines)
        return F.struct(c["negative"].alias("negative"), F.when(c["up"], raised).otherwise(c["kept"]).alias("digits"), c["places"].alias("places"))

    def pointed(c):
        return plain(c["negative"], F.left(c["digits"], F.char_length(c["digits"]) - c["places"]), F.right(c["digits"], c["places"]))

    def choose(c):
        return F.when(places_of(c["value"]) <= c["places"], c["value"]).otherwise(let(let(let(c, cut), carried), pointed))

    return let(F.struct(value.alias("value"), places.cast("int").alias("places")), choose)


def hundredth(value: Column) -> Column:
    """A value in plain form divided by 100."""
    wide = F.regexp_replace(value, r"^(-?)", "$100")
    return _clean(F.regexp_replace(wide, r"^(-?[0-9]*)([0-9]{2})\.?([0-9]*)$", "$1.$2$3"))


def extract_numbers(text, spoken: bool = False) -> Column:
    """F22. Array of {text, value, percent, decimals} in order of appearance; ``value`` in plain form.

    ``spoken`` reads "minus 3" as a sign, as narration texts write it.
    """
    pattern = F.lit("(?iU)" + (_SPOKEN if spoken else _WRITTEN))

    def token(raw):
        frac = F.regexp_extract(raw, _PARTS, 3)
        whole = F.replace(F.regexp_extract(raw, _PARTS, 2), F.lit(","), F.lit(""))
        return F.struct(
            F.regexp_replace(raw, r"(?U)^\s+|\s+$", "").alias("text"),
            plain(F.regexp_extract(raw, _PARTS, 1) != "", whole, F.substr(frac, F.lit(2))).alias("value"),
            (F.regexp_extract(raw, _PARTS, 4) != "").alias("percent"),
            F.greatest(F.char_length(frac) - 1, F.lit(0)).alias("decimals"),
        )

    return F.transform(F.regexp_extract_all(_col(text), pattern, F.lit(1)), token)


def match_forms(token: Column) -> Column:
    """J14. Array of {value, places}: a value that the token may equal, or that a known value rounded to ``places`` may."""
    value, percent, decimals = token["value"], token["percent"], token["decimals"]

    def form(v, places):
        return F.struct(v.alias("value"), places.cast("int").alias("places"))

    forms = F.array(
        form(value, F.when(percent | (decimals >= 1), decimals)),
        F.when(percent, form(hundredth(value), decimals + 2)),
    )
    return F.filter(forms, lambda o: o["value"].isNotNull())


def strip_citations(text, unknown) -> Column:
    """F24. Remove each unknown id with its brackets, then tidy the spaces."""

    def without(acc, cited):
        quoted = F.regexp_replace(cited, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        bracketed = F.regexp_replace(
            acc, F.concat(F.lit(r"\[\s*"), quoted, F.lit(r"\s*\]")), F.lit("")
        )
        return F.replace(bracketed, cited, F.lit(""))

    out = F.aggregate(_col(unknown), _col(text), without)
    out = F.regexp_replace(out, r"[ \t]+([.,;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")
