"""Rows and documents that runs give out: exposure rows, totals, outcomes, and comparisons as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import dates

from .tables import small


def exposure_rows(exposure: DataFrame, meta: DataFrame, key: str = "file_name", run: str | None = None, method: str = "direct") -> DataFrame:
    """A row of the summary for each exposure: who and when (the date cut at its first space), and counts with their total."""
    day, time = dates.cut_day_and_time(F.col("start_date"))
    m = meta.select(key, *[c for c in ("company_name", "company_ticker", "quarter") if c in meta.columns], day.alias("date"), time.alias("time"))
    x = exposure.select(key, F.col("keyword_set").alias("keyword_name"), "total_keywords_searched", "total_keywords_with_matches", "total_direct_matches", "total_cosine_matches", (F.col("total_direct_matches") + F.col("total_cosine_matches")).alias("total_matches"))
    return x.join(m, key, "left").withColumns({"match_id": F.lit(run), "matching_method": F.lit(method)})


def corpus_totals(counts: DataFrame, count: str = "shared_sentences_count") -> DataFrame:
    """One row: calls, calls with shared sentences, shared sentences in all."""
    return counts.agg(F.count("*").alias("total_calls"), F.count_if(F.col(count) > 0).alias("calls_with_shared"), F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("total_shared"))


def with_shared_counts(summary: DataFrame, counts: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows of a summary that have a count of shared sentences, with it."""
    return summary.join(counts, key, "left").dropna(subset=["shared_sentences_count"])


def stored_or_named(stored: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """key, transcript_path: the stored path where there is such a file, else the path of the file of that name.

    stored (key, file_path); files (name, path) with a row a name.
    """
    here = files.select(F.col("path").alias("file_path"), F.lit(True).alias("_there")).distinct()
    named = files.select(F.col("name").alias(key), F.col("path").alias("_named"))
    out = stored.select(key, "file_path").join(here, "file_path", "left").join(named, key, "left")
    return out.select(key, F.coalesce(F.when(F.col("_there"), F.col("file_path")), F.col("_named")).alias("transcript_path"))


def upload_outcome(company: Column, source: Column, known: Column) -> tuple[Column, Column]:
    """(status, reason) of a row that a remote table is to take; known says that its company has an id."""
    none = [(F.coalesce(company, F.lit("")) == "", "skipped", "No company name"), (~F.coalesce(known, F.lit(False)), "error", "Could not create company"), (F.coalesce(source, F.lit("")) == "", "skipped", "No source file")]
    status, reason = F.lit("success"), F.lit(None).cast("string")
    for test, s, r in reversed(none):
        status, reason = F.when(test, F.lit(s)).otherwise(status), F.when(test, F.lit(r)).otherwise(reason)
    return status, reason


def outcomes(rows: DataFrame) -> DataFrame:
    """status, reason, n."""
    return rows.groupBy("status", "reason").agg(F.count("*").alias("n"))


def comparison_document(common: DataFrame, sizes: DataFrame, first: str, second: str, key: str = "doc_id") -> DataFrame:
    """key, json: two sets' comparison as a nested document. common is sentence_map()'s of both sets, sizes compare()'s rows."""
    side = [F.max(F.when(F.col("keyword_set") == s, F.struct("keywords", F.col("texts").alias("matched_texts")))).alias(n) for n, s in (("file1", first), ("file2", second))]
    both = common.where(F.col("keyword_set").isin(first, second)).groupBy(key, "sentence").agg(*side).where("file1 is not null and file2 is not null")
    by = both.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sentence", F.struct("file1", "file2").alias("v"))))).alias("by_sentence"))
    names = {"n_first": "sentences_with_matches_file1", "n_second": "sentences_with_matches_file2", "n_union": "union_sentences_with_matches", "n_common": "common_sentences_with_matches", "pct_union": "pct_common_over_union", "pct_first": "pct_file1_sentences_overlapped", "pct_second": "pct_file2_sentences_overlapped"}
    meta = F.struct(F.lit(first).alias("file1_name"), F.lit(second).alias("file2_name"), *[F.col(a).alias(b) for a, b in names.items()])
    out = sizes.join(by, key, "left").select(key, meta.alias("metadata"), F.coalesce("by_sentence", F.create_map().cast(by.schema["by_sentence"].dataType)).alias("by_sentence"))
    return out.select(key, F.to_json(F.struct("metadata", "by_sentence")).alias("json"))


def shared_document(hits: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: the sentences that all sets share, and their number."""
    by = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence", "hits"))).alias("sentences"))
    out = counts.join(by, key, "left").select(key, "shared_sentences_count", F.coalesce("sentences", F.array().cast(by.schema["sentences"].dataType)).alias("sentences"))
    return out.select(key, F.to_json(F.struct("shared_sentences_count", "sentences")).alias("json"))


def metadata_issues(meta: DataFrame, expected: DataFrame, key: str = "file_name") -> DataFrame:
    """path, key, reason of stored results that can't count: unreadable, without a name, or of a file that isn't there.

    meta has path, key and error (null where it could be read).
    """
    e = expected.select(F.col(key).alias("_name")).where("_name is not null").distinct()
    m = meta.join(small(e), F.col(key) == F.col("_name"), "left")
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("TOML error: "), F.col("error"))).when(F.coalesce(key, F.lit("")) == "", F.lit("Missing document.file_name")).when(F.col("_name").isNull(), F.lit("File not found in earnings_calls_dir"))
    return m.select("path", F.when(F.col("error").isNull() & (F.col(key) != ""), F.col(key)).alias(key), reason.alias("reason")).where("reason is not null")
