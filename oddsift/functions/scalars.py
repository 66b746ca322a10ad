"""Row-wise column expressions. All of them stay in built-in functions."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of regional numbers.
DECIMAL_COMMA = r",[0-9]{1,6}$"
THOUSANDS_DOTS = r"^-?[0-9]{1,3}(\.[0-9]{3})+$"
FLOAT_LITERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CURRENCY_PREFIX = r"^R\$"

_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(c, _EDGES, "")


def is_filled(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (strip(c.cast("string")) != "")


def to_num(c: Column, dtype: T.DataType | None = None) -> Column:
    """Locale-tolerant number: ``1.200,5`` -> 1200.5, ``2.000`` -> 2000, ``10%`` -> 10.

    Anything that is not a finite number becomes null.
    """
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.NumericType):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    bare = F.regexp_replace(F.regexp_replace(c.cast("string"), _EDGES + "|[ \u00a0]", ""), CURRENCY_PREFIX, "")

    def plain(s: Column) -> Column:
        comma = s.rlike(DECIMAL_COMMA) | (s.contains(".") & s.contains(","))
        return (
            F.when(comma, F.translate(s, ",.", "."))
            .when(s.rlike(THOUSANDS_DOTS), F.translate(s, ".", ""))
            .otherwise(s)
        )

    number = _let(_let(F.regexp_replace(bare, "%+$", ""), plain), lambda s: F.when(s.rlike(FLOAT_LITERAL), s.try_cast("double")))
    return _let(number, lambda x: F.when(F.abs(x) != float("inf"), x))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def regional_text(c: Column) -> Column:
    """A number written with a decimal comma."""
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))


# The arithmetic of Hangul syllables in the Unicode standard.
SYLLABLES = range(0xAC00, 0xAC00 + 11172)
LEADS, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7
VOWELS_AND_TAILS, TAIL_COUNT = 588, 28


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """For translation: characters and their bases, marks (mapped to nothing) behind; and those with longer bases.

    Read from the character database, all scripts; Hangul syllables are left to arithmetic.
    """
    source, target, marks, longer = [], [], [], {}
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if ord(char) in SYLLABLES or 0xD800 <= ord(char) < 0xE000:
            continue
        base = "".join(p for p in unicodedata.normalize("NFD", char) if unicodedata.category(p) != "Mn")
        if not base:
            marks.append(char)
        elif len(base) > 1:
            longer[char] = base
        elif base != char:
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target), longer


def _spelled_out(text: Column) -> Column:
    """Hangul syllables as their letters, other characters with longer bases as these."""
    longer = _folds()[2]
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    leads = F.array(*[F.lit(chr(LEADS + i)) for i in range(len(SYLLABLES) // VOWELS_AND_TAILS)])
    vowels = F.array(*[F.lit(chr(VOWELS + i)) for i in range(VOWELS_AND_TAILS // TAIL_COUNT)])
    tails = F.array(F.lit(""), *[F.lit(chr(TAILS + i)) for i in range(1, TAIL_COUNT)])

    def letters(char: Column) -> Column:
        at = F.ascii(char) - SYLLABLES.start
        def pick(options: Column, n: Column) -> Column:
            return F.get(options, n.cast("int"))
        spelled = F.concat(
            pick(leads, F.floor(at / VOWELS_AND_TAILS)), pick(vowels, F.floor(at % VOWELS_AND_TAILS / TAIL_COUNT)),
            pick(tails, at % TAIL_COUNT),
        )
        return F.when((at >= 0) & (at < len(SYLLABLES)), spelled).otherwise(F.coalesce(F.try_element_at(table, char), char))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), letters), "")


def fold_text(c: Column) -> Column:
    """Accents and other marks dropped in every script, lower case, trimmed; null becomes the empty string.

    Most texts need one character translation; only texts with Hangul or characters of longer bases are spelled out.
    """
    source, target, longer = _folds()
    rare = f"[{chr(SYLLABLES.start)}-{chr(SYLLABLES[-1])}{''.join(longer)}]"
    text = c.cast("string")
    spelled = F.when(text.rlike(rare), _spelled_out(text)).otherwise(text)
    return F.coalesce(strip(F.lower(F.translate(spelled, source, target))), F.lit(""))


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def readable_number(c: Column) -> Column:
    """Integers plain, two decimals from 1 upwards, four significant digits below, no exponent."""
    x = c.cast("double")
    whole = F.when(F.abs(x) < 1e18, x.cast("bigint").cast("string")).otherwise(x.cast("decimal(38,0)").cast("string"))
    cents = _trim_zeros(F.bround(x.cast("decimal(38,10)"), 2).cast("string"))
    shift = F.pow(F.lit(10.0), F.lit(3.0) - F.floor(F.log10(F.abs(x))))
    fine = _trim_zeros((F.bround(x * shift, 0) / shift).cast("decimal(38,24)").cast("string"))
    return F.when(x == F.floor(x), whole).when(F.abs(x) >= 1, cents).otherwise(fine)


def readable(v: float) -> str:
    """``readable_number`` for a fitted constant."""
    if v != v or v in (float("inf"), float("-inf")):
        return str(v)
    if v == int(v):
        return str(int(v))
    if abs(v) >= 1:
        return f"{v:.2f}".rstrip("0").rstrip(".")
    places = 3 - math.floor(math.log10(abs(v)))
    return f"{v:.{places}f}".rstrip("0").rstrip(".")


def two_digits(c: Column) -> Column:
    """Two significant digits; an exponent only below 1e-4."""
    x = c.cast("double")
    power = F.floor(F.log10(F.abs(x)))
    shift = F.pow(F.lit(10.0), F.lit(1.0) - power)
    plain = _trim_zeros((F.bround(x * shift, 0) / shift).cast("decimal(38,10)").cast("string"))
    mantissa = _trim_zeros(F.format_string("%.1f", x / F.pow(F.lit(10.0), power)))
    small = F.concat(mantissa, F.lit("e-"), F.lpad((-power).cast("string"), 2, "0"))
    # lpad cuts longer text, and exponents reach three digits
    small = F.when(power <= -100, F.concat(mantissa, F.lit("e"), power.cast("string"))).otherwise(small)
    return F.when(x == 0, "0").when(power < -4, small).otherwise(plain)


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """NaN has no JSON form, so it becomes null."""
    return F.when(~F.isnan(c), c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def significant(c: Column, digits: int) -> Column:
    """Round to a number of significant digits, so that last-bit noise cannot split equal scores."""
    shift = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * shift, 0) / shift)


def cited_columns(messages: Column, columns: Sequence[str]) -> Column:
    """Names quoted inside an array of messages, kept only if they are real columns."""
    quoted = F.flatten(F.transform(messages, lambda m: F.regexp_extract_all(m, F.lit("'([^']+)'"), F.lit(1))))
    return F.array_intersect(F.array_distinct(quoted), F.array(*[F.lit(c) for c in columns]))


def vote_bucket(votes: Column, models: int) -> Column:
    """none, minority, or majority (more than half of the models)."""
    return F.when(votes == 0, "none").when(votes > models / 2, "majority").otherwise("minority")


def split_list(c: Column) -> Column:
    """``a,,b`` -> [a, b]."""
    return F.filter(F.split(c, ","), lambda x: x != "")
