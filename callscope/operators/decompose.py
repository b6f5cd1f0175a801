"""Documents as sentences, words and pairs with places; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import text as T


def placed(sents: Column) -> Column:
    """Array of (pos, sent_id, token) of the words of an array of sentences."""
    flat = F.flatten(F.transform(sents, lambda s, i: F.transform(T.words(s), lambda w: F.struct(i.alias("sent_id"), w.alias("token")))))
    return F.transform(flat, lambda x, p: F.struct(p.alias("pos"), x["sent_id"].alias("sent_id"), x["token"].alias("token")))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_id, text, n_tokens, first_pos."""
    sents = T.sentences(F.col(text))
    d = docs.select(key, sents.alias("s")).select(key, "s", F.transform("s", lambda x: F.size(T.words(x))).alias("n"))
    first = F.aggregate("n", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    return d.select(key, F.posexplode(F.arrays_zip("s", "n", first.alias("f"))).alias("sent_id", "x")).select(key, "sent_id", F.col("x.s").alias("text"), F.col("x.n").alias("n_tokens"), F.col("x.f").alias("first_pos"))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, sent_id, token, token_lc."""
    return docs.select(key, F.explode(placed(T.sentences(F.col(text)))).alias("x")).select(key, "x.pos", "x.sent_id", "x.token", F.lower("x.token").alias("token_lc"))


def bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, bigram; pairs cross the ends of sentences."""
    return docs.select(key, F.posexplode(T.pairs(T.words(F.col(text)))).alias("pos", "bigram"))


def shape(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "\n\n") -> DataFrame:
    """key, num_paragraphs, num_sentences, num_words (by white space)."""
    c = F.col(text)
    return docs.select(key, *[F.size(x).cast("bigint").alias(n) for n, x in (("num_paragraphs", T.paragraphs(c, mark)), ("num_sentences", T.sentences(c)), ("num_words", T.split_words(c)))])


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "\n\n") -> DataFrame:
    """key, tree: the document as nested paragraphs, sentences and words."""

    def sentence(s):
        return F.struct(s.alias("text"), T.split_words(s).alias("words"))

    return docs.select(key, F.transform(T.paragraphs(F.col(text), mark), lambda p: F.struct(p.alias("text"), F.transform(T.sentences(p), sentence).alias("sentences"))).alias("tree"))
