"""Keywords in documents: exact words, close vectors, and which match of a place counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import text as T
from callscope.functions.text import once

from .decompose import bigrams, placed
from .tables import small

INLINE = 20_000  # keywords that are looked up inside a document's array of words; more are joined
DIRECT = 0.99


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """keyword_set, ord, keyword, kw_lc: of spellings that differ in case the first."""
    k = keywords.withColumn("keyword", T.strip(F.col("keyword"))).where("keyword <> ''").withColumn("kw_lc", F.lower("keyword"))
    first = F.min_by(F.struct("ord", "keyword"), F.struct("ord", "keyword")).alias("x")
    return k.groupBy("keyword_set", "kw_lc").agg(first).select("keyword_set", F.col("x.ord").alias("ord"), F.col("x.keyword").alias("keyword"), "kw_lc")


def direct(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", inline: int = INLINE, context: int = 0) -> DataFrame:
    """key, keyword_set, ord, keyword, position, matched_text, context (the sentence, and so many on either side).

    Words that are no keyword are dropped inside the document's array, so neither they nor their sentences leave it.
    """
    k = distinct_keywords(keywords)
    known = [r[0] for r in k.select("kw_lc").distinct().limit(inline + 1).collect()]
    d = docs.select(key, T.sentences(F.col(text)).alias("_s"))
    hits = placed(F.col("_s"))
    if len(known) <= inline:
        hits = F.filter(hits, lambda x: F.lower(x["token"]).isin(known)) if known else F.slice(hits, 1, 0)
    # each hit takes its own sentences along, not the document's
    hits = F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), around(F.col("_s"), x["sent_id"], context).alias("context")))
    d = d.select(key, F.explode(hits).alias("x")).select(key, F.col("x.pos").alias("position"), F.col("x.token").alias("matched_text"), F.col("x.context").alias("context"))
    return d.join(small(k), F.lower("matched_text") == F.col("kw_lc")).select(key, "keyword_set", "ord", "keyword", "position", "matched_text", "context")


def known(keywords: DataFrame, inline: int = INLINE) -> dict[str, list[str]] | None:
    """The sets' keywords in lower case; nothing if they are too many to be looked up inside a document's array."""
    got = distinct_keywords(keywords).select("keyword_set", "kw_lc").limit(inline + 1).collect()
    if len(got) > inline:
        return None
    out: dict[str, list[str]] = {}
    for name, word in got:
        out.setdefault(name, []).append(word)
    return out


def one_of(word: Column, words: list[str]) -> Column:
    """Whether a word is, in any case, one of some in lower case."""
    return F.lower(word).isin(words) if words else F.lit(False)


def around(sents: Column, at: Column, context: int = 0) -> Column:
    """A sentence, and so many on either side."""
    if not context:
        return F.get(sents, at)
    first = F.greatest(at + 1 - context, F.lit(1))
    return T.strip(F.array_join(F.slice(sents, first, at + 2 + context - first), " "))


def with_variations(keywords: DataFrame, forms: DataFrame) -> DataFrame:
    """Keywords with their other word forms behind them; forms (word, form) says which there are, in any case.

    Of one spelling the first stays, so a form that is a keyword itself adds nothing.
    """
    k = keywords.withColumn("_w", F.lower("keyword"))
    f = forms.select(F.lower("word").alias("_w"), F.col("form")).where(F.lower("form") != F.col("_w")).distinct()
    top = keywords.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_t"))
    more = k.join(small(f), "_w").crossJoin(F.broadcast(top)).select("keyword_set", (F.col("_t") + 1 + F.col("ord")).alias("ord"), F.col("form").alias("keyword"))
    return distinct_keywords(keywords.select("keyword_set", "ord", "keyword").unionByName(more)).drop("kw_lc")


def close(corpus: DataFrame, keywords: DataFrame, threshold: float = 0.7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, ord, keyword, match_type, score: corpus rows whose cosine to a keyword's vector is at least threshold.

    Above DIRECT a match is direct, with score 1. keywords (ord, keyword, vector) goes to every task: its size is checked.
    """
    limit = 50_000
    got = keywords.select("ord", "keyword", "vector").orderBy("ord").limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} keywords")
    m = np.array([r["vector"] for r in got], float) if got else np.zeros((0, 1))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if got else m
    shared = corpus.sparkSession.sparkContext.broadcast((np.array([r["ord"] for r in got], np.int64), np.array([r["keyword"] for r in got], object), m))
    kind = corpus.schema[key].dataType.simpleString()

    def rows(batches):
        order, names, unit = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, unit.shape[1])
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ unit.T
            i, j = np.nonzero(s >= threshold)
            score = s[i, j]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i)), pa.array(order[j], pa.int64()), pa.array(names[j], pa.string()), pa.array(np.where(score > DIRECT, "direct", "cosine")), pa.array(np.where(score > DIRECT, 1.0, score))],
                [key, "ord", "keyword", "match_type", "score"],
            )

    return corpus.select(key, vector).where((F.size(vector) == m.shape[1]) & ~F.exists(vector, lambda x: x.isNull())).mapInArrow(rows, f"{key} {kind}, ord bigint, keyword string, match_type string, score double")


def best(matches: DataFrame, *place: str) -> DataFrame:
    """Of the matches of one place the highest score; ties go to the first keyword."""
    w = Window.partitionBy(*place).orderBy(F.desc("score"), "ord")
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bigrams_apart(bigrams: DataFrame, words: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """Matches of pairs that have no match of a word within one place. The range is spelt out, so the join is by equality."""
    near = words.select(key, F.explode(F.array(F.col(position) - 1, F.col(position), F.col(position) + 1)).alias(position)).distinct()
    return bigrams.join(near, [key, position], "left_anti")


def pairs_apart(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", inline: int = INLINE) -> DataFrame:
    """key, position, bigram: pairs of words that have no direct match within one place, found inside the document's array.

    Each row of docs is a document of its own; keywords too many for the array are joined by key and place, which rows of
    one key then share. A document without a key has no matches, so all its pairs stay.
    """
    words = known(keywords, inline)
    if words is None:
        b = bigrams(docs, key, text).withColumnRenamed("pos", "position")
        return bigrams_apart(b, direct(docs, keywords, key, text, inline), key)
    every = sorted({w for ws in words.values() for w in ws})

    def kept(w, hit):
        def at(i):
            return F.coalesce(F.get(hit, i), F.lit(False))

        def pair(x, i):
            apart = F.col(key).isNull() | ~(at(i - 1) | at(i) | at(i + 1))
            return F.when((i < F.size(w) - 1) & apart, F.struct(i.alias("position"), F.concat(x, F.lit(" "), F.get(w, i + 1)).alias("bigram")))

        return F.filter(F.transform(w, pair), lambda x: x.isNotNull())

    found = once(T.words(F.col(text)), lambda w: once(F.transform(w, lambda x: one_of(x, every)), lambda hit: kept(w, hit)))
    return docs.select(key, F.explode(found).alias("x")).select(key, "x.position", "x.bigram")


def cosine(docs: DataFrame, vectors: DataFrame, keywords: DataFrame, threshold: float = 0.7, mode: str = "word", exclude_duplicates: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit, position, matched_text, keyword, ord, match_type, score, context for mode word, bigram or hybrid.

    vectors (token, vector) has those of lower-case words and pairs: each is compared once, however often it occurs.
    """
    if mode not in ("word", "bigram", "hybrid"):
        raise ValueError(mode)
    like = close(vectors, keywords, threshold, "token", "vector")
    d = docs.select(key, T.sentences(F.col(text)).alias("_s")).select(key, "_s", placed(F.col("_s")).alias("_w"))
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    joined = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.struct(a["pos"].alias("pos"), a["sent_id"].alias("sent_id"), F.concat(a["token"], F.lit(" "), b["token"]).alias("token")))
    units = [(u, c) for u, c in (("word", F.col("_w")), ("bigram", joined)) if mode in (u, "hybrid")]
    out = None
    for unit, c in units:
        c = F.transform(c, lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), F.get("_s", x["sent_id"]).alias("context")))
        x = d.select(key, F.explode(c).alias("x")).select(key, F.lit(unit).alias("unit"), F.col("x.pos").alias("position"), F.col("x.token").alias("matched_text"), F.col("x.context").alias("context"), F.lower("x.token").alias("token"))
        out = x if out is None else out.unionByName(x)
    m = out.join(small(like), "token").drop("token")
    if not exclude_duplicates:
        return m
    m = best(m, key, "unit", "position")
    return m.where("unit = 'word'").unionByName(bigrams_apart(m.where("unit = 'bigram'"), m.where("unit = 'word'"), key)) if mode == "hybrid" else m
