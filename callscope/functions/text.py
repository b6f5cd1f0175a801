"""Text as arrays: words, pairs of words, sentences, paragraphs. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
BLANK = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once a row: inside a lambda an expression is evaluated anew at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores; none of a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def pairs(tokens: Column) -> Column:
    """Neighbouring words joined by a space."""

    def joined(w):
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))

    return once(tokens, joined)


def _kept(parts: Column) -> Column:
    return F.coalesce(F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Cut at white space after . ! or ?; stripped, blanks dropped."""
    return _kept(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"))


def paragraphs(text: Column, mark: str = "\n\n") -> Column:
    return _kept(F.split(text, mark))


def split_words(text: Column) -> Column:
    """Words by white space, as paragraphs and sentences count them."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def is_bigram(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*[\p{L}\p{N}]+\s+[\p{L}\p{N}]+\s*$"), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up to four places; 0 of nothing."""
    return F.coalesce(F.floor(F.lit(1e6) * part / F.nullif(whole.cast("double"), F.lit(0.0)) + F.lit(0.5)) / F.lit(1e4), F.lit(0.0))


def near4(x: Column) -> Column:
    """Four places. The bound lies beside the ties, so that the last bit of a sum doesn't decide."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.500001)) / F.lit(10000.0)


def safe_float(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def safe_int(c: Column) -> Column:
    """Through a double, cut toward zero; null where it isn't a number."""
    return c.cast("string").try_cast("double").try_cast("bigint")
