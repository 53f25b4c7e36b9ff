"""Neighbourhood filters on grids too large for one task: blocks with a rim of their neighbours' cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def filter_blocks(grid: DataFrame, value: str, kernel: Kernel, halo: int, block: int = 256, fill: float = np.nan) -> DataFrame:
    """(y, x, value) after ``kernel`` ran on each block with ``halo`` cells around it; absent cells hold ``fill``.

    Rim cells are dealt to all blocks they border, so each block is one task
    group of at most (block + 2 halo)^2 cells, whatever the grid's size.
    """
    if halo > block:
        raise ValueError("the halo is wider than a block")
    near = lambda a: F.array_distinct(F.array(*[F.floor((F.col(a) + d) / block) for d in (-halo, 0, halo)]))
    dealt = grid.select("y", "x", F.col(value).cast("double").alias("v")).withColumn("by", F.explode(near("y"))).withColumn("bx", F.explode(near("x")))

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * block - halo, int(key[1]) * block - halo
        a = np.full((block + 2 * halo,) * 2, fill)
        y, x = cells["y"].to_numpy() - y0, cells["x"].to_numpy() - x0
        a[y, x] = cells["v"]
        own = (y >= halo) & (y < block + halo) & (x >= halo) & (x < block + halo)
        out = kernel(a)
        return pd.DataFrame({"y": cells["y"][own], "x": cells["x"][own], value: out[y[own], x[own]]})

    kinds = {c: grid.schema[c].dataType.simpleString() for c in "yx"}
    return dealt.groupBy("by", "bx").applyInPandas(run, f"y {kinds['y']}, x {kinds['x']}, {value} double")


def _windows(a: np.ndarray, r: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, constant_values=np.nan), (2 * r + 1,) * 2)


def median(r: int) -> Kernel:
    return lambda a: np.nanmedian(np.where(np.isnan(_windows(a, r)).all((2, 3))[..., None, None], 0.0, _windows(a, r)), axis=(2, 3))


def gaussian(sigma: float, r: int) -> Kernel:
    """Weighted mean that leaves absent cells out of both sums."""
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k = np.outer(k, k)

    def run(a: np.ndarray) -> np.ndarray:
        w = _windows(a, r)
        there = ~np.isnan(w)
        return np.where(there, w, 0).__mul__(k).sum((2, 3)) / np.maximum((there * k).sum((2, 3)), 1e-300)

    return run


def erode(r: int) -> Kernel:
    return lambda a: np.nan_to_num(_windows(a, r), nan=0.0).min((2, 3))


def dilate(r: int) -> Kernel:
    return lambda a: np.nan_to_num(_windows(a, r), nan=0.0).max((2, 3))


def distance_to_background(limit: int) -> Kernel:
    """Euclidean distance to the nearest zero cell, exact up to ``limit`` (the halo), which is its largest value. Absent cells are no background."""

    def run(a: np.ndarray) -> np.ndarray:
        zero = np.where(a == 0, 0.0, np.inf)
        best = np.full(a.shape, float(limit) ** 2)
        for d in range(-limit, limit + 1):  # along x, then along y
            best = np.minimum(best, _moved(zero, d, 1) + d * d)
        out = np.full(a.shape, float(limit) ** 2)
        for d in range(-limit, limit + 1):
            out = np.minimum(out, _moved(best, d, 0) + d * d)
        return np.sqrt(out)

    return run


def _moved(a: np.ndarray, d: int, axis: int) -> np.ndarray:
    out = np.full(a.shape, np.inf)
    src, dst = [slice(None)] * 2, [slice(None)] * 2
    src[axis], dst[axis] = slice(max(0, -d), a.shape[axis] - max(0, d)), slice(max(0, d), a.shape[axis] - max(0, -d))
    out[tuple(dst)] = a[tuple(src)]
    return out


def boundary_gradient(low: float, high: float) -> Kernel:
    """1 where the central-difference gradient lies within inclusive thresholds."""

    def run(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1, mode="edge")
        g = np.hypot((p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2)
        return ((g >= low) & (g <= high)).astype(float)

    return run


def opening(r: int) -> Kernel:
    """1 where a disc of radius r inside the non-zero cells covers the cell. Needs a halo of 2 r + 1."""

    def run(a: np.ndarray) -> np.ndarray:
        inside = distance_to_background(r + 1)(np.nan_to_num(a, nan=0.0))
        centre = np.where(inside > r, 0.0, 1.0)
        return (distance_to_background(r + 1)(centre) <= r).astype(float)

    return run


def size_distribution(grid: DataFrame, value: str, radii: list[int], block: int = 256) -> DataFrame:
    """(radius, covered, share): non-zero cells that discs of each radius cover, and their share of all: the cumulative size of pores."""
    out = None
    solid = grid.withColumn(value, (F.col(value) != 0).cast("double"))
    for r in radii:
        one = filter_blocks(solid, value, opening(r), 2 * r + 1, block, fill=0.0).agg(F.lit(r).alias("radius"), F.coalesce(F.sum(value), F.lit(0.0)).cast("bigint").alias("covered"))
        out = one if out is None else out.unionByName(one)
    total = solid.agg(F.sum(value).alias("_t"))
    return out.crossJoin(F.broadcast(total)).select("radius", "covered", (F.col("covered") / F.nullif(F.col("_t"), F.lit(0.0))).alias("share"))
