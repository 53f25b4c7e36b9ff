"""Windows over depth: tumbling, sliding, session, smoothing, block means."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, depth: str, width: float, by: Sequence[str], *aggregates) -> DataFrame:
    """Half-open windows [start, end) from each group's first depth; the key is the window's end."""
    first = df.groupBy(*by).agg(F.min(depth).alias("_d0"))
    rows = df.join(first, list(by)) if by else df.crossJoin(F.broadcast(first))
    end = F.col("_d0") + (F.floor((F.col(depth) - F.col("_d0")) / width) + 1) * width
    return rows.groupBy(*by, end.alias("window_end")).agg(*aggregates)


def kde(df: DataFrame, value: str, by: Sequence[str], points: int, low: float, high: float, factor: float) -> DataFrame:
    """(by, i, x, density): Gaussian density at even places, bandwidth = factor times the sample deviation.

    One value, or equal ones, give a normal with deviation 0.01 around them.
    Values are gathered as counts of distinct values before they meet the grid.
    """
    stats = df.groupBy(*by).agg(F.count(value).alias("_n"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    h = F.when(F.col("_s") > 0, factor * F.col("_s")).otherwise(0.01)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).join(stats, list(by)).withColumn("_h", h)
    step = (high - low) / (points - 1)
    grid = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(low) + F.col("i") * F.lit(step))
    z = (F.col("x") - F.col(value)) / F.col("_h")
    return grid.groupBy(*by, "i", "x").agg((F.sum(F.col("_c") * F.exp(-z * z / 2)) / (F.max("_n") * F.max("_h") * math.sqrt(2 * math.pi))).alias("density"))


def heterogeneity(df: DataFrame, value: str, order: str, by: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Slope of log deviation of moving means against log size, sign turned: one pass of windows over the same sort."""
    w = Window.partitionBy(*by).orderBy(order)
    cols = df.select(*by, *[F.avg(value).over(w.rowsBetween(-(s // 2), s - s // 2 - 1)).alias(f"_m{s}") for s in sizes])
    stds = cols.groupBy(*by).agg(*[F.stddev_pop(f"_m{s}").alias(f"_m{s}") for s in sizes])
    long = stds.select(*by, F.explode(F.array(*[F.struct(F.lit(2 * math.log(s)).alias("x"), F.log(F.col(f"_m{s}") + 1e-9).alias("y")) for s in sizes])).alias("p")).select(*by, "p.*")
    return long.groupBy(*by).agg((-F.regr_slope("y", "x")).alias("index"))


def sessions(df: DataFrame, at: str, gap: float, by: Sequence[str], *aggregates) -> DataFrame:
    """Runs in which each row lies within ``gap`` of the one before; numbered from 1 per group."""
    w = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).groupBy(*by, "session").agg(*aggregates)


def smooth(df: DataFrame, value: str, order: str, by: Sequence[str], taps: Sequence[float]) -> DataFrame:
    """Weighted centred moving mean that leaves nulls out of both sums; null rows stay null."""
    w, half = Window.partitionBy(*by).orderBy(order), len(taps) // 2
    near = [(t, F.lead(value, i - half).over(w) if i >= half else F.lag(value, half - i).over(w)) for i, t in enumerate(taps)]
    top = sum(F.coalesce(v * t, F.lit(0.0)) for t, v in near)
    bottom = sum(F.when(v.isNotNull(), t).otherwise(0.0) for t, v in near)
    return df.withColumn("smoothed", F.when(F.col(value).isNotNull(), top / bottom))


def gaussian_taps(sigma: float, half: int) -> list[float]:
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def low_pass_taps(step: float, count: int, cut: float) -> list[float]:
    """Windowed-sinc low-pass filter, unit gain."""
    mid = (count - 1) / 2
    f = 2 * cut * step
    raw = [(f if i == mid else math.sin(math.pi * f * (i - mid)) / (math.pi * (i - mid))) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (count - 1))) for i in range(count)]
    return [x / sum(raw) for x in raw]


def moving_variance(df: DataFrame, value: str, order: str, by: Sequence[str], half: int) -> DataFrame:
    """E[v^2] - E[v]^2 over 2 half + 1 rows, cut at the ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    v = F.col(value)
    return df.withColumn("variance", F.avg(v * v).over(w) - F.pow(F.avg(v).over(w), 2))


def block_mean(df: DataFrame, value: str, blocks: dict[str, int]) -> DataFrame:
    """Mean of each block of the given sizes along the axes."""
    return df.groupBy(*[F.floor(F.col(a) / s).alias(a) for a, s in blocks.items()]).agg(F.avg(value).alias(value))


def sorted_rows(df: DataFrame, row: str, value: str, tie: str) -> DataFrame:
    """Each row's values in ascending order, with their place."""
    return df.select(row, F.col(value), F.row_number().over(Window.partitionBy(row).orderBy(value, tie)).alias("place"))


def running_start(df: DataFrame, length: str, order: str, by: Sequence[str]) -> DataFrame:
    """Sum of the lengths of all rows before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def by_last(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Values divided by the group's last one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("normalised", F.col(value) / F.nullif(F.last(value).over(w), F.lit(0)))


def circular_shift(df: DataFrame, row: str, x: str, value: str, shift: str, n: int) -> DataFrame:
    """Each row's values moved by ``shift`` places around a circle of n, fractions linear; a null shift leaves the row."""
    k = F.coalesce(F.col(shift).cast("double"), F.lit(0.0))
    part = k - F.floor(k)
    to = F.array(F.struct(F.pmod(F.col(x) + F.floor(k), F.lit(n)).alias("x"), (1 - part).alias("w")), F.struct(F.pmod(F.col(x) + F.floor(k) + 1, F.lit(n)).alias("x"), part.alias("w")))
    return df.withColumn("_t", F.explode(to)).groupBy(row, F.col("_t.x").cast("int").alias(x)).agg(F.sum(F.col(value) * F.col("_t.w")).alias(value))


def cross_correlation(a: DataFrame, order: str, left: str, right: str, by: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """(by, lag, r): sum of left(i) right(i + lag) over each group: one sort, one window column per lag."""
    w = Window.partitionBy(*by).orderBy(order)
    moved = a.select(*by, *[(F.col(left) * (F.lead(right, k).over(w) if k >= 0 else F.lag(right, -k).over(w))).alias(f"_c{i}") for i, k in enumerate(lags)])
    one = moved.groupBy(*by).agg(*[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(lags))])
    return one.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{i}").alias("r")) for i, k in enumerate(lags)])).alias("p")).select(*by, "p.*")


def spiral_noise(df: DataFrame, image: str, z: str, x: str, value: str, turns: int, spacing: float, longest: float = 100.0, shortest: float = 3.0, transit: float = 0.02) -> DataFrame:
    """Adds noise and filtered: the first harmonic around the well, limited to wave lengths along it, and the values without it.

    x counts ``turns`` columns around, z rows of ``spacing``. The harmonic of
    each row is a sum; one task per image transforms that column (one complex
    number per row) and weighs its frequencies with smooth steps ``transit``
    wide on both sides of the band. Missing cells count as the image's mean.
    """
    mean = df.groupBy(image).agg(F.avg(value).alias("_mean"))
    rows = df.join(mean, image)
    turn = F.col(x) * (2 * math.pi / turns)
    d = F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0))
    first = rows.groupBy(image, z).agg(F.sum(d * F.cos(turn)).alias("re"), F.sum(-d * F.sin(turn)).alias("im"))

    def step(i: np.ndarray, low: float, high: float) -> np.ndarray:
        t = np.clip((i - low) / (high - low), 0, 1)
        return t * t * (3 - 2 * t)

    def band(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(z)
        n = len(part)
        half = max(1, round(spacing * transit * n))
        low, high = round(2 * spacing / longest * n), round(2 * spacing / shortest * n)
        at = np.arange(n)
        weight = step(at, low - half, low + half) * (1 - step(at, high - half, high + half))
        got = np.fft.ifft(np.fft.fft(part["re"].to_numpy() + 1j * part["im"].to_numpy()) * weight)
        return pd.DataFrame({image: part[image], z: part[z], "_re": got.real, "_im": got.imag})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (image, z)}
    smooth = first.groupBy(image).applyInPandas(band, f"{image} {kinds[image]}, {z} {kinds[z]}, _re double, _im double")
    noise = 2 / turns * (F.col("_re") * F.cos(turn) - F.col("_im") * F.sin(turn))
    return df.join(smooth, [image, z]).withColumn("noise", noise).withColumn("filtered", F.col(value) - F.col("noise")).drop("_re", "_im")


def noise_indicator(df: DataFrame, image: str, z: str, noise: str, width: int) -> DataFrame:
    """(image, z, indicator): each row's mean absolute noise, averaged over ``width`` rows around; beyond the ends counts the mean of all."""
    rows = df.groupBy(image, z).agg(F.avg(F.abs(noise)).alias("_m"))
    mean = rows.groupBy(image).agg(F.avg("_m").alias("_all"))
    w = Window.partitionBy(image).orderBy(z).rowsBetween(-(width // 2), (width - 1) // 2)
    near = rows.join(mean, image).select(image, z, "_all", (F.col("_m") - F.col("_all")).alias("_d"))
    return near.select(image, z, (F.sum("_d").over(w) / width + F.col("_all")).alias("indicator"))
