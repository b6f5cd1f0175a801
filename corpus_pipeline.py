"""A training corpus from raw documents: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm.common import table, written
from callscope.llm.decontaminate import clean
from callscope.llm.jaccard_join import deduplicate
from callscope.llm.language_id import accepted
from callscope.llm.mixing import mixed_documents
from callscope.llm.token_output import token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the least id."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of words with the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources at their target weights, as documents."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequency-ranked token ids in a byte-aligned code."""
    return token_output(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token output", tokens)]

#: A network trained here decides in the first stage, and public tokens are cut in the last two: SQL can't say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
