"""Depth windows over streams of samples, with event time in the place of depth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, size: str, by: list[str], value: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of a value per tumbling (or sliding) window; rows later than ``late`` are dropped."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Runs of samples less than ``gap`` apart."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n", "total")


def job_progress(stream: DataFrame, key: str, time: str, progress: str) -> DataFrame:
    """(key, last, n): the highest progress seen of each job and its number of reports, kept as state between batches."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (0.0, 0)
        for f in frames:
            best, n = max(best, float(f[progress].max())), n + len(f)
        state.update((best, n))
        yield pd.DataFrame({key: [k[0]], "last": [best], "n": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, last double, n bigint", "best double, n bigint", "update", "NoTimeout")
