"""Keyword lists, results of earlier runs, and the forms in which results are given out."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import strip
from callscope.operators.batches import first_by, merged

META = "keyword_doc_name string, earnings_call_name string, cosine_threshold double, runtime_seconds double, total_keywords_searched bigint, total_keywords_with_matches bigint, total_direct_matches bigint, total_cosine_matches bigint, total_sentences_in_document bigint, total_sentences_with_match bigint, percent_sentences_with_match double"
HIT = "keyword: string, matched_text: string, type: string, position: int, score: double"
WORD = "direct_matches: array<struct<matched_text: string, context: string, position: int>>, cosine_matches: array<struct<matched_text: string, context: string, similarity_score: double, position: int>>"
EXPOSURE = f"metadata struct<{META.replace(' string', ': string').replace(' double', ': double').replace(' bigint', ': bigint')}>, matches map<string, struct<{WORD}>>, matches_by_sentence map<string, struct<matches: array<struct<{HIT}>>>>"


def keywords(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """keyword_set (file name), ord, keyword: every cell of every line, in order; header drops the first line.

    Cells may be quoted, with commas, line ends and doubled quotes inside.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    lines = spark.read.text(path, wholetext=True).select(name.alias("keyword_set"), F.posexplode(F.split("value", r"(?:\r\n|\n|\r)" + outside)).alias("line", "v"))
    cells = lines.where(F.col("line") >= (1 if header else 0)).select("keyword_set", "line", F.posexplode(F.split("v", "," + outside)).alias("cell", "k"))
    bare = strip("k")
    k = F.when(bare.rlike('(?s)^".*"$'), strip(F.replace(bare.substr(F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')))).otherwise(bare)
    return cells.select("keyword_set", (F.col("line").cast("bigint") * 1_000_000 + F.col("cell")).alias("ord"), k.alias("keyword")).where("keyword <> ''")


def word_list(spark: SparkSession, path: str, header: bool | None = False, heading: str = "word") -> DataFrame:
    """word: the first column, underscores as spaces, lower case, blanks dropped; header None looks whether the file begins with the heading."""
    if header is None:
        top = spark.read.csv(path).limit(1).collect()
        header = bool(top) and (top[0][0] or "").strip().lower() == heading
    first = spark.read.csv(path, header=header).select(F.col("*"))
    c = first.columns[0]
    return first.select(strip(F.lower(F.translate(f"`{c}`", "_", " "))).alias("word")).where("word <> ''").distinct()


def exposures(spark: SparkSession, path: str) -> DataFrame:
    """Stored exposures of either form, below a folder; of one call and set the file whose path sorts last."""
    raw = spark.read.schema(EXPOSURE).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", mode="PERMISSIVE").withColumn("path", F.col("_metadata.file_path"))
    raw = raw.where("metadata.keyword_doc_name is not null and metadata.earnings_call_name is not null")
    searched = F.coalesce(F.col("metadata.total_keywords_searched"), F.when(F.col("matches").isNotNull(), F.size("matches").cast("bigint")))
    raw = raw.withColumn("metadata", F.col("metadata").withField("total_keywords_searched", searched))
    return first_by(raw.withColumns({"call": F.col("metadata.earnings_call_name"), "keyword_set": F.col("metadata.keyword_doc_name")}), ["call", "keyword_set"], F.desc("path"))


def exposure_matches(e: DataFrame) -> DataFrame:
    """call, keyword_set, keyword, match_type, matched_text, context, position, score from both forms."""
    base = ["call", "keyword_set"]
    w = e.select(*base, F.explode("matches").alias("keyword", "m"))
    d = w.select(*base, "keyword", F.lit("direct").alias("match_type"), F.explode("m.direct_matches").alias("x")).select(*base, "keyword", "match_type", "x.matched_text", "x.context", "x.position", F.lit(1.0).alias("score"))
    c = w.select(*base, "keyword", F.lit("cosine").alias("match_type"), F.explode("m.cosine_matches").alias("x")).select(*base, "keyword", "match_type", "x.matched_text", "x.context", "x.position", F.col("x.similarity_score").alias("score"))
    s = e.select(*base, F.explode("matches_by_sentence").alias("context", "m")).select(*base, "context", F.explode("m.matches").alias("x")).select(*base, "x.keyword", F.col("x.type").alias("match_type"), "x.matched_text", "context", "x.position", "x.score")
    return d.unionByName(c).unionByName(s)


def toml_rows(spark: SparkSession, path: str, pattern: str = "*.toml") -> DataFrame:
    """path, document, document_attr (maps of strings), error: what is stored beside results; a bad file gives its error."""

    def rows(frames):
        for f in frames:
            out = []
            for p, t in zip(f["path"], f["value"]):
                try:
                    d = tomllib.loads(t)
                    out.append((p, *({k: str(v) for k, v in d.get(n, {}).items()} for n in ("document", "document_attr")), None))
                except tomllib.TOMLDecodeError as e:
                    out.append((p, {}, {}, str(e)))
            import pandas as pd

            yield pd.DataFrame(out, columns=["path", "document", "document_attr", "error"])

    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(rows, "path string, document map<string,string>, document_attr map<string,string>, error string")


def summary_csv(spark: SparkSession, path: str, day: str = "date") -> DataFrame:
    """A summary that write_csv made, its day as a date (null where it is none)."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn(day, F.try_to_date(F.substring(day, 1, 10)))


def vault_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One wide row a call; cells in quotes may go over several lines."""
    r = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def integrity_report(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_path of what a saved report misses."""
    kinds = "missing_details array<struct<file_name: string, file_path: string>>"
    return spark.read.schema(kinds).json(path, multiLine=True).select(F.inline("missing_details"))


def pair_of(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two stored exposures that may be compared: the same form and call, other keywords; else a ValueError."""
    e = [spark.read.schema(EXPOSURE).json(p, multiLine=True) for p in (first, second)]
    shape = [x.select("metadata.keyword_doc_name", "metadata.earnings_call_name", F.col("matches").isNotNull(), F.col("matches_by_sentence").isNotNull()).collect() for x in e]
    if any(len(x) != 1 for x in shape):
        raise ValueError("each file must hold one exposure")
    (a, call_a, *form_a), (b, call_b, *form_b) = shape[0][0], shape[1][0]
    for wrong, why in ((form_a != form_b, "the files differ in form"), (a == b, "both files are of the same keywords"), (call_a != call_b, "the files are of two calls")):
        if wrong:
            raise ValueError(why)
    both = e[0].unionByName(e[1])
    return both.withColumns({"call": F.col("metadata.earnings_call_name"), "keyword_set": F.col("metadata.keyword_doc_name")})


def companies(spark: SparkSession, url: str, table: str, key: str = "id", lower: int = 0, upper: int = 1_000_000, parts: int = 16, **properties) -> DataFrame:
    """A remote table, read in ranges of its key. newest() leaves a row a company."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties)


def newest(rows: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """Of rows with the same names the last by key."""
    return first_by(rows, names, F.desc(key))


def write_csv(path: str, *frames: DataFrame, order: str | None = None) -> None:
    """One CSV of all rows under the sorted union of columns, as a report for people: it has a row a document."""
    out = merged(*frames)
    (out.orderBy(order) if order else out).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Documents that are JSON already (key, json), a line each, in a folder that is named by the run."""
    df.select(F.col("json").alias("value")).write.mode("errorifexists").text(path)
