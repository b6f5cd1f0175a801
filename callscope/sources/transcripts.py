"""Call transcripts as XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import dates
from callscope.operators import sections

SCHEMA = "EventStory struct<Headline: string, Body: string>, eventTitle string, city string, companyName string, companyTicker string, startDate string"


def reader(spark: SparkSession, stream: bool = False, pattern: str = "*.[xX][mM][lL]", recursive: bool = False, skip_on_error: bool = True):
    r = (spark.readStream if stream else spark.read).format("xml").schema(SCHEMA)
    return r.options(rowTag="Event", pathGlobFilter=pattern, recursiveFileLookup=str(recursive).lower(), mode="PERMISSIVE" if skip_on_error else "FAILFAST")


def transcripts(raw: DataFrame) -> DataFrame:
    """file_name, file_path, event_title, city, company_name, company_ticker, start_ts, start_date, quarter, year, body."""
    quarter, year = dates.quarter_and_year(F.coalesce("eventTitle", F.lit("")))
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.coalesce("eventTitle", F.lit("")).alias("event_title"),
        "city",
        F.col("companyName").alias("company_name"),
        F.col("companyTicker").alias("company_ticker"),
        dates.call_time(F.col("startDate")).alias("start_ts"),
        dates.gmt(F.col("startDate")).alias("start_date"),
        quarter.alias("quarter"),
        year.alias("year"),
        F.coalesce("EventStory.Body", F.lit("")).alias("body"),
    )


def anywhere(spark: SparkSession, path: str | list[str], pattern: str = "*.[xX][mM][lL]", recursive: bool = False) -> DataFrame:
    """The same columns from files whose body lies at any depth: the first Body of the document counts."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    x = F.col("value")
    top = {n: F.xpath_string(x, F.lit(f"/*/{n}")) for n in ("eventTitle", "city", "companyName", "companyTicker", "startDate")}
    there = {n: F.when(F.size(F.xpath(x, F.lit(f"/*/{n}/text()"))) > 0, v) for n, v in top.items()}
    body = F.struct(F.lit(None).cast("string").alias("Headline"), F.xpath_string(x, F.lit("(//Body)[1]")).alias("Body")).alias("EventStory")
    return transcripts(raw.select(body, *[v.alias(n) for n, v in there.items()], "_metadata"))


def read(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Transcripts of a folder or of files; a path that doesn't exist, or holds no transcript, is an error."""
    t = transcripts(reader(spark, **options).load(path))
    if not t.inputFiles():
        raise FileNotFoundError(f"no transcripts in {path}")
    return t


def index(spark: SparkSession, roots: list[str], pattern: str = "*.[xX][mM][lL]") -> DataFrame:
    """name, path of the files below the roots, which are listed, not read; of one name that of the first root, then path."""
    out = None
    for i, root in enumerate(roots):
        f = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup="true").load(root).select(F.lit(i).alias("root_ord"), "path", F.element_at(F.split("path", "/"), -1).alias("name"))
        out = f if out is None else out.union(f)
    return by_name(out)


def section_rows(t: DataFrame, strict: bool = False) -> DataFrame:
    """file_name, section (full, presentation, qa, match_text), text."""
    b = F.col("body")
    parts = {"full": sections.spoken(b, strict), "presentation": sections.spoken(sections.presentation(b), strict), "qa": sections.spoken(sections.questions(b), strict), "match_text": sections.match_text(b, strict)}
    return t.select("file_name", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("text")) for k, v in parts.items()])).alias("x")).select("file_name", "x.*")


def by_name(files: DataFrame) -> DataFrame:
    """Of files (root_ord, path, name) the first of each name: by root, then path."""
    return files.groupBy("name").agg(F.min(F.struct("root_ord", "path")).alias("x")).select("name", "x.path")
