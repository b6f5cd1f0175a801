"""Keeping batches: what is missing, what is done, what is newest, and dimension rows made where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def missing(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return expected.join(results.select(key).distinct(), key, "left_anti")


def integrity(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """present, missing, issues (results that nothing was expected for) and both totals, from one pass over each side."""
    e = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("r"))
    both = e.union(results.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("e").alias("e"), F.max("r").alias("r"), F.sum("r").alias("n"))
    return both.agg(
        F.sum(F.col("e") * F.col("r")).cast("bigint").alias("present"),
        F.sum(F.col("e") * (1 - F.col("r"))).cast("bigint").alias("missing"),
        F.sum(F.col("r") * (1 - F.col("e"))).cast("bigint").alias("issues"),
        F.sum("e").cast("bigint").alias("total_transcripts"),
        F.sum("n").cast("bigint").alias("total_metadata_files"),
    )


def pending(docs: DataFrame, runs: DataFrame, keyword_name: str, method: str, key: str = "file_name") -> DataFrame:
    """Documents that have no run with this set and method."""
    if method not in ("direct", "cosine"):
        raise ValueError(method)
    return missing(docs, runs.where((F.col("keyword_name") == keyword_name) & (F.col("matching_method") == method)), key)


def with_ids(rows: DataFrame, dimension: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The dimension with new ids for keys that it lacks, after its highest; null keys are equal. The same at every run."""
    fresh = rows.select(*keys).distinct().alias("r")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    fresh = fresh.join(dimension.select(*keys).alias("d"), on, "left_anti")
    top = dimension.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    # the ids of a range of keys begin after those of the ranges before it: no window over all rows
    ranged = fresh.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    ranged = settled(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*keys))), "new-keys")  # its bounds are drawn, so it is made once
    n = ranged.groupBy("_p").agg(F.max("_i").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # what is sent has a row a partition, and one row
    made = ranged.join(F.broadcast(before), "_p").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("_i")).cast("bigint").alias(id_col), *keys)
    return dimension.select(id_col, *keys).unionByName(made)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows instead of its own of equal keys; of several new ones with a key, whichever sorts last."""
    latest = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("x")).select(*keys, "x.*")
    return missing_by(old, latest, keys).unionByName(latest)


def missing_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    n = new.select(*keys).alias("n")
    o = old.alias("o")
    return o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti")


def merged(*frames: DataFrame) -> DataFrame:
    """Rows of all, with the sorted union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
