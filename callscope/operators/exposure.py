"""Exposure of documents to sets of keywords, in numbers and in nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as T

from .match import INLINE, direct, distinct_keywords
from .tables import small


def summary(docs: DataFrame, keywords: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and set, whether anything matches or not. Equal sentences count once among the matched."""
    if "match_type" not in matches.columns:
        matches = matches.withColumn("match_type", F.lit("direct"))
    sets = distinct_keywords(keywords).groupBy("keyword_set").agg(F.count("*").alias("total_keywords_searched"))
    base = docs.select(key, F.size(T.sentences(F.col(text))).cast("bigint").alias("total_sentences_in_document")).crossJoin(small(sets))
    got = matches.groupBy(key, "keyword_set").agg(
        F.size(F.collect_set("keyword")).cast("bigint").alias("total_keywords_with_matches"),
        F.count_if(F.col("match_type") == "direct").alias("total_direct_matches"),
        F.count_if(F.col("match_type") == "cosine").alias("total_cosine_matches"),
        F.size(F.collect_set(F.when(F.col("context") != "", F.xxhash64("context")))).cast("bigint").alias("total_sentences_with_match"),
    )
    out = base.join(got, [key, "keyword_set"], "left").fillna(0)
    return out.withColumn("percent_sentences_with_match", _share())


def direct_summary(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", inline: int = INLINE) -> DataFrame:
    """The same of direct matches alone, counted inside each row's array: nothing is shuffled.

    Beyond so many keywords, matches are made and counted by summary().
    """
    got = distinct_keywords(keywords).groupBy("keyword_set").agg(F.collect_list("kw_lc").alias("k")).orderBy("keyword_set")
    if got.agg(F.coalesce(F.sum(F.size("k")), F.lit(0))).first()[0] > inline:
        return summary(docs, keywords, direct(docs, keywords, key, text), key, text)
    sets = [(r["keyword_set"], r["k"]) for r in got.collect()]
    known = sorted({k for _, ks in sets for k in ks})

    def hits(s):
        return F.transform(F.filter(F.transform(T.words(s), F.lower), lambda w: w.isin(known)), lambda w: F.struct(w.alias("w"), F.xxhash64(s).alias("s")))

    def counted(name, own):
        h = F.filter("_h", lambda x: x["w"].isin(own))
        kinds = (("total_keywords_with_matches", F.size(F.array_distinct(F.transform(h, lambda x: x["w"])))), ("total_direct_matches", F.size(h)), ("total_cosine_matches", F.lit(0)), ("total_sentences_with_match", F.size(F.array_distinct(F.transform(h, lambda x: x["s"])))))
        return F.struct(F.lit(name).alias("keyword_set"), F.lit(len(own)).cast("bigint").alias("total_keywords_searched"), *[c.cast("bigint").alias(n) for n, c in kinds])

    d = docs.select(key, T.sentences(F.col(text)).alias("_s"))
    d = d.select(key, F.size("_s").cast("bigint").alias("total_sentences_in_document"), (F.flatten(F.transform("_s", hits)) if known else F.array()).alias("_h"))
    out = d.select(key, "total_sentences_in_document", F.explode(F.array(*[counted(*x) for x in sets])).alias("x")).select(key, "total_sentences_in_document", "x.*")
    return out.withColumn("percent_sentences_with_match", _share())


def _share():
    return F.when(F.col("total_sentences_in_document") > 0, F.lit(100.0) * F.col("total_sentences_with_match") / F.col("total_sentences_in_document")).otherwise(F.lit(0.0))


def by_keyword(docs: DataFrame, keywords: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword_set, keyword, n: each keyword of each document, those without matches too."""
    n = matches.groupBy(key, "keyword_set", "keyword").agg(F.count("*").alias("n"))
    every = docs.select(key).distinct().crossJoin(small(distinct_keywords(keywords).select("keyword_set", "keyword")))
    return every.join(n, [key, "keyword_set", "keyword"], "left").fillna(0, ["n"])


def unique_matches(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.groupBy(key, "keyword_set").agg(F.array_sort(F.collect_set(F.lower("matched_text"))).alias("texts"))


def word_form(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword_set, matches: keyword -> its direct and cosine matches in the order of places."""
    m = _typed(matches)
    d = F.collect_list(F.when(F.col("match_type") == "direct", F.struct("position", "matched_text", "context")))
    c = F.collect_list(F.when(F.col("match_type") == "cosine", F.struct("position", "matched_text", "context", F.col("score").alias("similarity_score"))))
    g = m.groupBy(key, "keyword_set", "keyword").agg(F.struct(F.array_sort(d).alias("direct_matches"), F.array_sort(c).alias("cosine_matches")).alias("v"))
    return g.groupBy(key, "keyword_set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "v")))).alias("matches"))


def sentence_form(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, keyword_set, matches_by_sentence: sentence -> its matches; matches without a sentence are left out."""
    m = _typed(matches).where("context <> ''")
    one = F.struct("position", "keyword", "matched_text", F.col("match_type").alias("type"), "score")
    g = m.groupBy(key, "keyword_set", "context").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return g.groupBy(key, "keyword_set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", F.struct(F.col("m").alias("matches")))))).alias("matches_by_sentence"))


def _typed(m: DataFrame) -> DataFrame:
    m = m if "match_type" in m.columns else m.withColumn("match_type", F.lit("direct"))
    return m if "score" in m.columns else m.withColumn("score", F.lit(1.0))


def report(summary_row, matches: list) -> str:
    """A printed account of one document's exposure."""
    r = summary_row.asDict()
    head = [f"Keywords searched: {r['total_keywords_searched']}, with matches: {r['total_keywords_with_matches']}", f"Direct: {r['total_direct_matches']}, cosine: {r['total_cosine_matches']}", f"Sentences: {r['total_sentences_with_match']} of {r['total_sentences_in_document']} ({r['percent_sentences_with_match']:.4f} %)"]
    return "\n".join(head + [f"  {m['keyword']}: {m['matched_text']} at {m['position']}" + (f" ({m['score']:.4f})" if "score" in m else "") for m in matches])
