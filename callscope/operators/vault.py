"""Features of sections, one wide row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as T
from callscope.functions.readability import indices

from .sentiment import lexicon

VAULT_INDICES = ["coleman_liau_index", "dale_chall_readability_score", "automated_readability_index", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "text_standard"]
PLURAL = ["we", "us", "our", "ours", "ourselves"]


def features(rows: DataFrame, keys: list[str], positive: list[str], negative: list[str], text: str = "text", speaker: str | None = None) -> DataFrame:
    """Of each key: words, sentences, numbers and plural pronouns as shares of words, question marks, and list scores."""
    w = T.words(F.col(text))
    p, n = lexicon(w, positive, negative)
    x = rows.select(
        *keys,
        *([speaker] if speaker and speaker not in keys else []),
        F.size(w).cast("bigint").alias("w"),
        F.size(T.sentences(F.col(text))).cast("bigint").alias("s"),
        F.size(F.filter(w, lambda t: t.rlike(r"^\d+$"))).cast("bigint").alias("d"),
        F.size(F.filter(w, lambda t: F.lower(t).isin(PLURAL))).cast("bigint").alias("we"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"\?")), F.lit(0)).cast("bigint").alias("q"),
        p.alias("p"),
        n.alias("n"),
    )
    more = [F.count_distinct(speaker).alias("speakers")] if speaker else []
    g = x.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("w", "s", "d", "we", "q", "p", "n")], *more)

    def share(a):
        return F.coalesce(F.col(a) / F.nullif(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0))

    return g.select(
        *keys,
        F.col("w").alias("word_count"),
        F.col("s").alias("sentence_count"),
        share("d").alias("numeric_ratio"),
        share("we").alias("plural_pronouns"),
        F.col("q").alias("question_marks"),
        F.col("p").alias("lm_positive"),
        F.col("n").alias("lm_negative"),
        (F.col("p") - F.col("n")).alias("lm_net_sentiment"),
        ((F.col("p") - F.col("n")) / (F.col("p") + F.col("n") + F.lit(1e-6))).alias("lm_polarity"),
        F.coalesce((F.col("p") + F.col("n")) / F.nullif(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("lm_subjectivity"),
        *(["speakers"] if speaker else []),
    )


def label_shares(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    names = ("positive", "neutral", "negative")
    g = rows.groupBy(*keys).agg(F.count(label).alias("n"), *[F.count_if(F.col(label) == x).alias(f"{x}_count") for x in names])
    return g.select(*keys, *[f"{x}_count" for x in names], *[T.percent(F.col(f"{x}_count"), F.col("n")).alias(f"{x}_percentage") for x in names])


def wide(rows: DataFrame, key: str, section: str, sections: list[str], values: list[str]) -> DataFrame:
    """One row a key; columns <section>_<value>. The sections are given, so no pass is made to find them."""
    return rows.groupBy(key).pivot(section, sections).agg(*[F.first(v).alias(v) for v in values])


def risk_share(matches: DataFrame, keys: list[str], exposure_set: str, risk_set: str) -> DataFrame:
    """Of each key: sentences with a word of the one set (exposure_count), and the share of them with one of the other too."""
    s = matches.where(F.col("keyword_set").isin(exposure_set, risk_set) & (F.col("context") != "")).groupBy(*keys, "context").agg(*[F.max((F.col("keyword_set") == x).cast("int")).alias(n) for n, x in (("e", exposure_set), ("r", risk_set))])
    g = s.where("e = 1").groupBy(*keys).agg(F.count("*").alias("exposure_count"), F.sum("r").alias("_r"))
    return g.select(*keys, "exposure_count", T.percent(F.col("_r"), F.col("exposure_count")).alias("risk_percentage"))


def section_readability(rows: DataFrame, keys: list[str], text: str = "text", easy: list[str] | None = None) -> DataFrame:
    """The indices of each section's text; rows have one a section."""
    r = indices(rows.select(*keys, text), text, easy)
    return r.select(*keys, *VAULT_INDICES)
