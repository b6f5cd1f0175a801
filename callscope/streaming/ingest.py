"""New transcripts as they come: each file once, results upserted by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.sources.transcripts import reader, transcripts


def ingest(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **options):
    """Run sink on the transcripts that have come since the last call, then stop. A batch repeated after a loss has the same number."""
    rows = transcripts(reader(spark, stream=True, **options).load(folder))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its number, written over if it is repeated."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def windowed(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window of event time, for tables and streams alike; what comes later than late is dropped by a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
