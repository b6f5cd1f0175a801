"""Readability by the published formulas, over counts of words, sentences, letters and syllables (groups of vowels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sentences, words

VOWELS = "[aeiouyAEIOUYàâäáéèêëíìîïóòôöúùûü]+"
GRADES = ("flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "gunning_fog", "linsear_write_formula")


def _syllables(w: Column) -> Column:
    return F.greatest(F.regexp_count(w, F.lit(VOWELS)), F.lit(1))


def counts(docs: DataFrame, text: str = "text", easy: list[str] | None = None) -> DataFrame:
    """doc columns and n_words, n_sentences, n_chars, n_letters, n_syllables, n_complex (3 syllables), n_hard.

    Hard words have two syllables at least and aren't among the easy ones.
    """
    d = docs.withColumn("_w", words(F.col(text))).withColumn("_y", F.transform("_w", _syllables))
    known = F.array(*[F.lit(x) for x in easy or []]).cast("array<string>")
    hard = F.filter(F.array_distinct(F.transform("_w", F.lower)), lambda w: (_syllables(w) >= 2) & ~F.array_contains(known, w))
    first = F.slice("_y", 1, 100)
    return d.select(
        *docs.columns,
        F.size("_w").cast("bigint").alias("n_words"),
        F.size(sentences(F.col(text))).cast("bigint").alias("n_sentences"),
        F.coalesce(F.length(F.regexp_replace(F.col(text), r"\s", "")), F.lit(0)).cast("bigint").alias("n_chars"),
        F.coalesce(F.length(F.regexp_replace(F.col(text), r"[^\p{L}]", "")), F.lit(0)).cast("bigint").alias("n_letters"),
        F.aggregate("_y", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_syllables"),
        F.size(F.filter("_y", lambda x: x >= 3)).cast("bigint").alias("n_complex"),
        F.size(hard).cast("bigint").alias("difficult_words"),
        F.aggregate(first, F.lit(0), lambda a, x: a + F.when(x >= 3, 3).otherwise(1)).cast("bigint").alias("n_linsear"),
    )


def indices(docs: DataFrame, text: str = "text", easy: list[str] | None = None) -> DataFrame:
    """The ten indices; 0 for texts without words."""
    c = counts(docs, text, easy)
    w, s, y, p = (F.col(x).cast("double") for x in ("n_words", "n_sentences", "n_syllables", "n_complex"))
    letters, chars, hard = (F.col(x).cast("double") for x in ("n_letters", "n_chars", "difficult_words"))
    share = hard / w * 100
    lin = F.col("n_linsear") / s
    e = {
        "flesch_reading_ease": 206.835 - 1.015 * w / s - 84.6 * y / w,
        "flesch_kincaid_grade": 0.39 * w / s + 11.8 * y / w - 15.59,
        "smog_index": F.when(s >= 3, 1.043 * F.sqrt(30 * p / s) + 3.1291).otherwise(F.lit(0.0)),
        "coleman_liau_index": 0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8,
        "automated_readability_index": 4.71 * chars / w + 0.5 * w / s - 21.43,
        "dale_chall_readability_score": 0.1579 * share + 0.0496 * w / s + F.when(share > 5, F.lit(3.6365)).otherwise(F.lit(0.0)),
        "linsear_write_formula": F.when(lin > 20, lin / 2).otherwise((lin - 2) / 2),
        "gunning_fog": 0.4 * (w / s + 100 * p / w),
    }
    known = (F.col("n_words") > 0) & (F.col("n_sentences") > 0)
    out = c.withColumns({k: F.when(known, v).otherwise(F.lit(0.0)) for k, v in e.items()})
    grade = F.array_sort(F.array(*[F.round(F.col(g)).cast("int") for g in GRADES]))
    often = F.transform(F.array_distinct(grade), lambda g: F.struct((-F.size(F.filter(grade, lambda x: x == g))).alias("n"), g.alias("g")))
    g = F.array_min(often)["g"]
    return out.withColumn("text_standard", F.concat((g - 1).cast("string"), F.lit("th and "), g.cast("string"), F.lit("th grade"))).drop("n_linsear")
