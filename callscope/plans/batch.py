"""Whole runs: a folder of transcripts to results, another set on stored text, checks and repairs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import dates, readability
from callscope.operators import batches, compare, decompose, exposure, match, reports, sentiment
from callscope.sources import files, transcripts


@dataclass
class Setup:
    """Word lists, and a model in place of them for sentences' sentiment."""

    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    easy: list[str] = field(default_factory=list)
    hiv4_positive: list[str] = field(default_factory=list)
    hiv4_negative: list[str] = field(default_factory=list)
    score: object = None
    strict: bool = False

    @classmethod
    def of(cls, what: Setup | dict | list | None) -> Setup:
        """From a setup, a dict of its fields, or a list of setups, of which the first counts."""
        if isinstance(what, list):
            what = what[0] if what else None
        return cls(**what) if isinstance(what, dict) else what or cls()


def document_attributes(t: DataFrame, setup: Setup | dict | list | None = None, run_sentiment: bool = True) -> DataFrame:
    """One row a transcript: what its file says, counts, readability and sentiment of the whole cleaned body."""
    setup = Setup.of(setup)
    full = transcripts.section_rows(t, setup.strict).where("section = 'full'").select("file_name", "text")
    out = t.drop("body").join(decompose.shape(full, "file_name").join(readability.indices(full, easy=setup.easy).drop("text", "n_words", "n_sentences", "n_chars", "n_letters", "n_syllables", "n_complex"), "file_name"), "file_name")
    if run_sentiment:
        out = out.join(sentiment.rolled_up(full, setup.positive, setup.negative, setup.score, "file_name", hiv4=(setup.hiv4_positive, setup.hiv4_negative)), "file_name")
    day, time = dates.day_and_time(F.col("start_date"))
    return out.withColumns({"date": day, "time": time})


def match_documents(t: DataFrame, keywords: DataFrame, method: str = "direct", vectors: DataFrame | None = None, keyword_vectors: DataFrame | None = None, threshold: float = 0.7, mode: str = "word", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matches, and the exposure of each transcript."""
    text = transcripts.section_rows(t, strict).where("section = 'match_text'").select("file_name", "text")
    if method == "direct":
        m = match.direct(text, keywords, "file_name")
    elif method == "cosine":
        if vectors is None or keyword_vectors is None:
            raise ValueError("cosine matching needs the vectors of tokens and keywords")
        m = None
        for name in set_names(keywords):  # a set at a time, as the best match of a place is that of its own set
            own = match.distinct_keywords(keywords.where(F.col("keyword_set") == name)).select("kw_lc")
            near = keyword_vectors.withColumn("kw_lc", F.lower("keyword")).join(own, "kw_lc", "left_semi").drop("kw_lc")
            found = match.cosine(text, vectors, near, threshold, mode, key="file_name").withColumn("keyword_set", F.lit(name))
            m = found if m is None else m.unionByName(found)
    else:
        raise ValueError(method)
    return m, exposure.summary(text, keywords, m, "file_name")


def set_names(keywords: DataFrame) -> list[str]:
    """The sets of a keyword table; it is a parameter, and small."""
    return sorted(r[0] for r in keywords.select("keyword_set").distinct().collect())


def single(spark: SparkSession, path: str, setup: Setup | dict | list | None = None, run_sentiment: bool = True, keywords: DataFrame | None = None) -> dict:
    """One transcript's attributes, and its exposure if keywords are given."""
    t = transcripts.read(spark, [path])
    out = {"document_attr": document_attributes(t, setup, run_sentiment).first().asDict()}
    if keywords is not None:
        out["exposure"] = [r.asDict() for r in match_documents(t, keywords)[1].collect()]
    return out


def new_batch(spark: SparkSession, input_dir: str | list[str], output_dir: str, setup: Setup | None = None, run_sentiment: bool = True, keywords: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Read, analyse, store as Parquet under output_dir and print a summary CSV there. Rerunning writes the same files over."""
    t = transcripts.read(spark, input_dir, **options)
    t.write.mode("overwrite").parquet(f"{output_dir}/transcripts")
    t = spark.read.parquet(f"{output_dir}/transcripts")
    document_attributes(t, setup, run_sentiment).write.mode("overwrite").parquet(f"{output_dir}/document_attr")
    out = {"transcripts": t, "document_attr": spark.read.parquet(f"{output_dir}/document_attr")}
    files.write_csv(f"{output_dir}/summary_csv", out["document_attr"], order="file_name")
    if keywords is not None:
        out |= existing_batch(spark, output_dir, keywords)
    return out


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table of a batch; None before its first run."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


RUNS = "file_name string, keyword_name string, matching_method string, run_id string"


def existing_batch(spark: SparkSession, output_dir: str, keywords: DataFrame, method: str = "direct", **options) -> dict[str, DataFrame]:
    """Match what is stored and has no run with a set and method yet; one run a set.

    A run's matches and exposures carry its id; its rows in match_runs are written last and make it count. What a run leaves
    that is lost before that is never read, so resuming repeats nothing.
    """
    for name in set_names(keywords):
        t, own, run = spark.read.parquet(f"{output_dir}/transcripts"), keywords.where(F.col("keyword_set") == name), uuid.uuid4().hex
        if (runs := _stored(spark, f"{output_dir}/match_runs", RUNS)) is not None:
            t = batches.pending(t, runs, name, method)
        m, x = match_documents(t, own, method, **options)
        m.withColumn("run_id", F.lit(run)).write.mode("append").parquet(f"{output_dir}/matches")
        x.withColumn("run_id", F.lit(run)).write.mode("append").parquet(f"{output_dir}/exposure")
        x.select("file_name", F.lit(name).alias("keyword_name"), F.lit(method).alias("matching_method"), F.lit(run).alias("run_id")).write.mode("append").parquet(f"{output_dir}/match_runs")
    return matched(spark, output_dir)


def matched(spark: SparkSession, output_dir: str) -> dict[str, DataFrame]:
    """matches, exposure and match_runs of the runs that ended."""
    runs = spark.read.schema(RUNS).parquet(f"{output_dir}/match_runs")
    done = runs.select("run_id").distinct()
    return {n: spark.read.parquet(f"{output_dir}/{n}").join(F.broadcast(done) if done.count() <= 100_000 else done, "run_id", "left_semi") for n in ("matches", "exposure")} | {"match_runs": runs}


def exposure_csv(spark: SparkSession, output_dir: str, path: str) -> DataFrame:
    """The exposures of all runs as a summary, written to path."""
    got, meta = matched(spark, output_dir), spark.read.parquet(f"{output_dir}/transcripts")
    runs = got["match_runs"].select("file_name", F.col("keyword_name").alias("keyword_set"), "run_id", "matching_method")
    rows = reports.exposure_rows(got["exposure"], meta).drop("match_id", "matching_method")
    rows = rows.join(runs.withColumnsRenamed({"keyword_set": "keyword_name", "run_id": "match_id"}), ["file_name", "keyword_name"])
    files.write_csv(path, rows, order="file_name")
    return rows


def check_integrity(spark: SparkSession, input_dir: str, output_dir: str, save: str | None = None, **options) -> dict[str, DataFrame]:
    """counts, missing and issues of a batch; with save, a report of them is written there."""
    t, r = transcripts.read(spark, input_dir, **options), spark.read.parquet(f"{output_dir}/document_attr")
    stored = r.select(F.col("file_path").alias("path"), "file_name", F.lit(None).cast("string").alias("error"))
    out = {"counts": batches.integrity(t, r, "file_name"), "missing": batches.missing(t.select("file_name", "file_path"), r, "file_name"), "issues": reports.metadata_issues(stored, t)}
    if save:
        lists = [out[n].agg(F.array_sort(F.collect_list(F.struct(*out[n].columns))).alias(c)) for n, c in (("missing", "missing_details"), ("issues", "metadata_issues"))]
        files.write_json(out["counts"].crossJoin(lists[0]).crossJoin(lists[1]).coalesce(1), save)  # one row each
    return out


def repair_batch(spark: SparkSession, input_dir: str, output_dir: str, setup: Setup | dict | list | None = None, run_sentiment: bool = True, snapshot: str | None = None, **options) -> dict[str, DataFrame]:
    """Analyse what is missing, or what a saved report says is, append it, then check again."""
    gone = files.integrity_report(spark, snapshot).select("file_name") if snapshot else check_integrity(spark, input_dir, output_dir, **options)["missing"].select("file_name")
    t = transcripts.read(spark, input_dir, **options).join(gone, "file_name", "left_semi")
    t = batches.missing(t, spark.read.parquet(f"{output_dir}/document_attr"), "file_name")
    document_attributes(t, setup, run_sentiment).write.mode("append").parquet(f"{output_dir}/document_attr")
    return check_integrity(spark, input_dir, output_dir, **options)


def compare_files(spark: SparkSession, first: str, second: str, normalize=None, export: str | None = None) -> DataFrame:
    """Two stored exposures of a call against each other, as in compare(); with export, the nested document is written there."""
    e = files.pair_of(spark, first, second)
    one, two = (spark.read.schema(files.EXPOSURE).json(p, multiLine=True).first()["metadata"]["keyword_doc_name"] for p in (first, second))
    m = files.exposure_matches(e)
    sizes = compare.compare(m, one, two, "call", normalize)
    if export:
        files.write_documents(reports.comparison_document(compare.sentence_map(m, "call", normalize), sizes, one, two, "call"), export)
    return sizes


def find_shared_sentences(spark: SparkSession, results_dir: str, keyword_names: list[str], normalize=None, export: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sentences that all sets share, and their numbers; with export, a nested document a call is written there."""
    e = files.exposures(spark, results_dir).where(F.col("keyword_set").isin(keyword_names))
    hits, counts = compare.shared_sentences(files.exposure_matches(e), keyword_names, "call", e.select("call", "keyword_set"), normalize)
    if export:
        files.write_documents(reports.shared_document(hits, counts, "call"), export)
    return hits, counts


def upload_rows(attrs: DataFrame, year: int | Column) -> DataFrame:
    """Rows as a remote table takes them: renamed, cast where that is possible, only those with a company and a file.

    upload_statuses() says what becomes of the others.
    """
    from callscope.functions.text import safe_float, safe_int

    whole = ("num_sentences", "num_words", "difficult_words")
    real = {"sentiment": "sentiment", "ml": "ml_score", "lm": "lm_score", "hiv4": "hiv4_score", "flesch_reading_ease": "flesch_reading_ease", "flesch_kincaid_grade": "flesch_kincaid_grade", "smog_index": "smog_index", "coleman_liau_index": "coleman_liau_index", "automated_readability_index": "automated_readability", "dale_chall_readability_score": "dale_chall_score", "linsear_write_formula": "linsear_write_formula", "gunning_fog": "gunning_fog"}
    kept = attrs.where("company_name is not null and company_name <> '' and file_name is not null")
    return kept.select("company_name", "company_ticker", F.lit(year).cast("int").alias("year"), F.col("file_name").alias("source_file"), "event_title", dates.upload_date(F.col("start_date")).alias("event_date"), "city", *[safe_int(F.col(c)).alias(c) for c in whole], *[safe_float(F.col(c)).alias(n) for c, n in real.items() if c in attrs.columns], "text_standard")


def upload_statuses(attrs: DataFrame, companies: DataFrame) -> DataFrame:
    """file_name, status and reason of each row; companies (name, ticker, id) has those that a remote table knows."""
    c = companies.select(F.col("name").alias("_n"), F.col("ticker").alias("_t")).distinct()
    known = attrs.join(c, (F.col("company_name") == F.col("_n")) & F.col("company_ticker").eqNullSafe(F.col("_t")), "left")
    status, reason = reports.upload_outcome(F.col("company_name"), F.col("file_name"), F.col("_n").isNotNull())
    return known.select("file_name", status.alias("status"), reason.alias("reason"))
