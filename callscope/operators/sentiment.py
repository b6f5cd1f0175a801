"""Sentiment by word lists or by a model, rolled up from sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as T


def signed(label: Column, score: Column) -> Column:
    return F.when(label == "neutral", 0.0).when(label == "positive", score).otherwise(-score)


def _in(x: Column, words: list[str]) -> Column:
    return x.isin(words) if words else F.lit(False)


def lexicon(tokens: Column, positive: list[str], negative: list[str]) -> tuple[Column, Column]:
    """How many words are in either list. The lists are parameters of bounded size and are looked up by hash."""
    low = F.transform(tokens, F.lower)

    def count(own: list[str]) -> Column:
        return F.size(F.filter(low, lambda w: _in(w, [x.lower() for x in own]))).cast("bigint")

    return count(positive), count(negative)


def pair_score(tokens: Column, positive: list[str], negative: list[str]) -> Column:
    """Neighbouring words both positive less those both negative."""
    sign = F.transform(tokens, lambda w: F.when(_in(F.lower(w), positive), 1).when(_in(F.lower(w), negative), -1).otherwise(0))
    n = F.greatest(F.size(sign) - 1, F.lit(0))
    both = F.zip_with(F.slice(sign, F.lit(1), n), F.slice(sign, F.lit(2), n), lambda a, b: F.when((a == 1) & (b == 1), 1).when((a == -1) & (b == -1), -1).otherwise(0))
    return F.aggregate(both, F.lit(0), lambda a, x: a + x).cast("bigint")


def scorer(make: Callable[[], Callable[[list[str]], Iterable[float]]], batch: int = 32):
    """A model as a column function: make() is called once by a worker, its result with lists of texts."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            text = s.fillna("").tolist()
            yield pd.Series([float(x) for x in in_batches(model, text, batch)], dtype=float)

    return run


def lexicon_scorer(positive: list[str], negative: list[str]) -> Callable[[Column], Column]:
    """The stand-in for a model: (p - n) / (p + n) of a sentence, 0 without either."""

    def score(text: Column) -> Column:
        p, n = lexicon(T.words(text), positive, negative)
        return F.coalesce((p - n).cast("double") / F.nullif((p + n).cast("double"), F.lit(0.0)), F.lit(0.0))

    return score


def _scores(words: Column, positive: list[str], negative: list[str], hiv4: tuple[list[str], list[str]]) -> tuple[Column, Column, Column]:
    up, down = lexicon(words, positive, negative)
    good, bad = lexicon(words, *hiv4)
    return pair_score(words, positive, negative), up - down, good - bad


def rolled_up(docs: DataFrame, positive: list[str], negative: list[str], score: Callable[[Column], Column] | None = None, key: str = "doc_id", text: str = "text", mark: str = "\n\n", hiv4: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """key, sentiment, ml, lm, hiv4: sentiment is the mean over paragraphs of their sentences' mean; the others are sums.

    Word lists score a row inside its own array, and nothing is shuffled. A model of columns (score) needs a row a sentence,
    which are then gathered; rows with the same key are one document there.
    """
    if score is not None:
        return _modelled(docs, positive, negative, score, key, text, mark, hiv4)
    low = F.transform(T.paragraphs(F.col(text), mark), lambda p: F.transform(T.sentences(p), lambda s: F.transform(T.words(s), F.lower)))
    up, down = [x.lower() for x in positive], [x.lower() for x in negative]
    zero = F.lit(0).cast("bigint")

    def sentence(w):
        p, n = (F.size(F.filter(w, lambda x: _in(x, own))).cast("double") for own in (up, down))
        ml, lm, hv = _scores(w, positive, negative, hiv4)
        return F.struct(F.coalesce((p - n) / F.nullif(p + n, F.lit(0.0)), F.lit(0.0)).alias("x"), ml.alias("ml"), lm.alias("lm"), hv.alias("hiv4"))

    def total(rows, name):
        return F.aggregate(rows, zero, lambda a, r: a + r[name])

    def mean(rows):
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(rows).cast("double"), F.lit(0.0))

    d = docs.select(key, F.filter(low, lambda p: F.size(p) > 0).alias("_p")).select(key, F.transform("_p", lambda p: F.transform(p, sentence)).alias("_p"))
    flat = F.flatten("_p")
    means = F.transform("_p", lambda p: mean(F.transform(p, lambda r: r["x"])))
    return d.select(key, F.coalesce(mean(means), F.lit(0.0)).alias("sentiment"), *[F.coalesce(total(flat, n), zero).alias(n) for n in ("ml", "lm", "hiv4")])


def _modelled(docs, positive, negative, score, key, text, mark, hiv4) -> DataFrame:
    p = docs.select(key, F.posexplode(T.paragraphs(F.col(text), mark)).alias("par", "p"))
    s = p.select(key, "par", F.explode(T.sentences(F.col("p"))).alias("s"))
    ml, lm, hv = _scores(T.words(F.col("s")), positive, negative, hiv4)
    s = s.select(key, "par", score(F.col("s")).alias("x"), ml.alias("ml"), lm.alias("lm"), hv.alias("hiv4"))
    par = s.groupBy(key, "par").agg(F.avg("x").alias("x"), *[F.sum(n).alias(n) for n in ("ml", "lm", "hiv4")])
    got = par.groupBy(key).agg(F.avg("x").alias("sentiment"), *[F.sum(n).alias(n) for n in ("ml", "lm", "hiv4")])
    return docs.select(key).distinct().join(got, key, "left").fillna(0)


def embedded(tokens: DataFrame, make: Callable[[], Callable[[list[str]], Iterable]], token: str = "token", batch: int = 32) -> DataFrame:
    """(token, vector) of each distinct lower-case token, by a model that is made once a worker."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            yield pd.Series([[float(y) for y in v] for v in in_batches(model, s.tolist(), batch)])

    return tokens.select(F.lower(token).alias("token")).where("token is not null").distinct().select("token", run("token").alias("vector"))


def in_batches(model: Callable[[list[str]], Iterable], text: list[str], batch: int) -> Iterator:
    """The model's answers; where it runs out of memory, the batch is halved from there on."""
    at = 0
    while at < len(text):
        try:
            got = list(model(text[at : at + batch]))
        except MemoryError:
            if batch == 1:
                raise
            batch = max(1, batch // 2)
            continue
        yield from got
        at += batch
