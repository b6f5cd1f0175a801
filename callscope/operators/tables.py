"""Small tables: which of two sides may be sent to all executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most limit rows; else as it is, so that both sides are shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again, so that each reader sees the same ones whichever executors are lost.

    The folder is spark.checkpoint.dir; only a session of one process may do without and use its tables' folder.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_settled"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
