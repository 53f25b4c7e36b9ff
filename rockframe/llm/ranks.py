"""Ranks over whole tables from counts of buckets: no task orders more than a bucket, or than the counts of a run of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose counts one task adds up; runs of buckets are added up from their sums.
RUN_BITS = 12


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """Adds the 0-based rank within ``keys`` by (``bucket``, ``order``); bucket is a whole number from 0.

    A row's rank is the rows in lower runs of buckets, plus those in lower
    buckets of its run, plus its rank in its own bucket.
    """
    lower = (Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.shiftright(bucket, RUN_BITS))
    runs = counts.groupBy(*keys, "_run").agg(F.sum("_n").alias("_m"))
    runs = runs.withColumn("_first", F.coalesce(F.sum("_m").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_run").rowsBetween(*lower)), F.lit(0)))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_run").orderBy(bucket).rowsBetween(*lower)), F.lit(0))
    offsets = counts.withColumn("_in", inner).join(runs.drop("_m"), [*keys, "_run"]).select(*keys, bucket, (F.col("_first") + F.col("_in")).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.withColumn("_in", F.row_number().over(inside)).join(offsets, [*keys, bucket]).withColumn(rank, F.col("_before") + F.col("_in") - 1).drop("_in", "_before")
