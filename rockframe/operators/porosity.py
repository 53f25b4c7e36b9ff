"""Porosity and permeability from grids, and further label operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.operators.tables import beside_one


def saturated_porosity(dry: Column, wet: Column, air: float, water: float) -> Column:
    """Pore share of a cell from its values dry and saturated, cut to 0..1."""
    return F.least(F.greatest((wet - dry) / (water - air), F.lit(0.0)), F.lit(1.0))


def porosity_counts(grid: DataFrame, phi: str) -> DataFrame:
    """One row: cells, those exactly 1 (macro) and exactly 0 (solid), the rest (micro), mean porosity."""
    p = F.col(phi)
    return grid.agg(F.count(F.lit(1)).alias("cells"), F.count_if(p == 1).alias("macro"), F.count_if(p == 0).alias("solid"), F.count_if((p > 0) & (p < 1)).alias("micro"), F.avg(p).alias("porosity"))


def mixed_porosity(dry: Column, wet: Column, label: Column, mask: Column, pore: int, solid: int, markers: dict[str, float]) -> Column:
    """Dry and wet images mixed by their pore and calcite markers, then label rules.

    (wet - cw - dry + cd) / (pw - cw - pd + cd); masked cells are 0, pores 1,
    labels from ``solid`` on 0, label 0 0, the rest cut to 0..1.
    """
    m = markers
    raw = (wet - m["cw"] - dry + m["cd"]) / (m["pw"] - m["cw"] - m["pd"] + m["cd"])
    return F.when(mask == 0, 0.0).when(label == pore, 1.0).when(label >= solid, 0.0).when(label == 0, 0.0).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def permeability_model(proportions: DataFrame, porosity: str, macro: str, p0: float, segments: dict[str, tuple[float, float]], to: str = "permeability") -> DataFrame:
    """p0 macro + sum of a share phi^b over the other segments."""
    total = F.lit(p0) * F.col(macro)
    for name, (a, b) in segments.items():
        total = total + F.lit(a) * F.col(name) * F.pow(porosity, F.lit(b))
    return proportions.withColumn(to, total)


def interval_products(samples: DataFrame, intervals: DataFrame, depth: str, value: str, ends: tuple[str, str], cell: float) -> DataFrame:
    """Intervals with the mean of the samples inside (ends included) times their thickness."""
    low, high = ends
    spread = intervals.withColumn("_c", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))
    hit = spread.join(samples.withColumn("_c", F.floor(F.col(depth) / cell)), "_c").where(F.col(depth).between(F.col(low), F.col(high)))
    return hit.groupBy(*intervals.columns).agg((F.avg(value) * (F.max(high) - F.max(low))).alias("product"))


def window_deviation(grid: DataFrame, axis: str, by: Sequence[str], value: str, sizes: Sequence[int]) -> DataFrame:
    """(size, deviation): population deviation of moving means of each length, over full windows: how large a sample represents the whole.

    Prefix sums come from one sort; a window's sum is the difference of two.
    """
    w = Window.partitionBy(*by).orderBy(axis)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.select(F.sum(value).over(up).alias("s"), F.row_number().over(w).alias("i"), *by)
    lagged = sums.select("i", *[F.when(F.col("i") >= k, (F.col("s") - F.coalesce(F.lag("s", k).over(Window.partitionBy(*by).orderBy("i")), F.lit(0.0))) / k).alias(f"m{k}") for k in sizes])
    one = lagged.agg(*[F.stddev_pop(f"m{k}").alias(f"m{k}") for k in sizes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"m{k}").alias("deviation")) for k in sizes])).alias("r")).select("r.*")


def axis_variogram(grid: DataFrame, axis: str, by: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """(lag, gamma, pairs) along one axis of a grid: one sort, one window column per lag; only cells exactly a lag apart count."""
    reach = lambda k: Window.partitionBy(*by).orderBy(axis).rangeBetween(k, k)
    d = grid.select(*[F.pow(F.first(value).over(reach(k)) - F.col(value), 2).alias(f"d{k}") for k in lags])
    one = d.agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in lags], *[F.count(f"d{k}").alias(f"n{k}") for k in lags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"d{k}") / 2).alias("gamma"), F.col(f"n{k}").alias("pairs")) for k in lags])).alias("r")).select("r.*")


def largest(cells: DataFrame, n: int, component: str = "component") -> DataFrame:
    """Cells of the n components with the most cells, the lowest id among equals."""
    top = cells.groupBy(component).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), component).limit(n)
    return cells.join(F.broadcast(top.select(component)), component, "left_semi")


def face_flags(grid: DataFrame, axes: Sequence[str], label: str = "label") -> DataFrame:
    """(label, axis_min, axis_max ...): whether each non-zero label touches each face of the grid."""
    ends = [F.min(a).alias(f"_{a}0") for a in axes] + [F.max(a).alias(f"_{a}1") for a in axes]
    both = beside_one(grid, *ends).where(F.col(label) != 0)
    return both.groupBy(label).agg(*[F.max(F.col(a) == F.col(f"_{a}{i}")).alias(f"{a}_{name}") for a in axes for i, name in enumerate(("min", "max"))])


def throat_geometry(throats: DataFrame) -> DataFrame:
    """Adds shape_factor r^2 / (4 A) within 0.01..0.09, mid_length of at least a hundredth of the length, and volume."""
    r, a, length = F.col("radius"), F.col("area"), F.col("length")
    mid = F.greatest(length - F.col("length_0") - F.col("length_1"), length * 0.01)
    return throats.withColumn("shape_factor", F.least(F.greatest(r * r / (4 * a), F.lit(0.01)), F.lit(0.09))).withColumn("mid_length", mid).withColumn("volume", length * a)


def throat_porosity(throats: DataFrame) -> DataFrame:
    """Adds porosity: that of the unresolved ends (phase 2) by their length, 1 if both ends are resolved."""
    w = [F.when(F.col(f"phase_{i}") == 2, F.col(f"length_{i}")).otherwise(0.0) for i in (0, 1)]
    mean = (w[0] * F.col("porosity_0") + w[1] * F.col("porosity_1")) / F.nullif(w[0] + w[1], F.lit(0.0))
    return throats.withColumn("porosity", F.coalesce(mean, F.lit(1.0)))


def radial_median(grid: DataFrame, center: tuple[float, float], value: str) -> DataFrame:
    """(ring, median, n): cells by rounded distance from a centre, rings half open."""
    d = F.sqrt(F.pow(F.col("y") - center[0], 2) + F.pow(F.col("x") - center[1], 2))
    return grid.groupBy(F.floor(d + 0.5).alias("ring")).agg(F.percentile(value, 0.5).alias("median"), F.count(value).alias("n"))


def label_boundaries(grid: DataFrame, label: str = "label") -> DataFrame:
    """Cells of 2 x 2 windows that hold two or more different non-zero labels; background cells are left out."""
    corners = grid.where(F.col(label) != 0).select("y", "x", F.col(label).alias("l"))
    dealt = corners.select("y", "x", "l", F.explode(F.array(*[F.struct((F.col("y") - i).alias("wy"), (F.col("x") - j).alias("wx")) for i in (0, 1) for j in (0, 1)])).alias("w"))
    mixed = dealt.groupBy("w.wy", "w.wx").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b").select("wy", "wx")
    hit = mixed.select(F.explode(F.array(*[F.struct((F.col("wy") + i).alias("y"), (F.col("wx") + j).alias("x")) for i in (0, 1) for j in (0, 1)])).alias("c")).select("c.y", "c.x").distinct()
    return grid.where(F.col(label) != 0).join(hit, ["y", "x"], "left_semi")


def window_codes(grid: DataFrame, solid: Column) -> DataFrame:
    """(code, n): how often each of the 16 patterns of solid cells fills a 2 x 2 window: the input of area, perimeter and Euler number."""
    ones = grid.where(solid).select("y", "x")
    bits = [(0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)]
    dealt = ones.select(F.explode(F.array(*[F.struct((F.col("y") - i).alias("wy"), (F.col("x") - j).alias("wx"), F.lit(b).alias("b")) for i, j, b in bits])).alias("w")).select("w.*")
    return dealt.groupBy("wy", "wx").agg(F.sum("b").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def minkowski_2d(codes: DataFrame) -> DataFrame:
    """One row (area, perimeter, euler4) from window codes of a picture with an empty rim: each cell is in four windows."""
    cells, code = F.expr("bit_count(code)"), F.col("code")
    h = lambda a, b: ((code.bitwiseAND(F.lit(a)) > 0) != (code.bitwiseAND(F.lit(b)) > 0)).cast("int")
    edges = h(1, 2) + h(4, 8) + h(1, 4) + h(2, 8)
    n = F.col("n")
    q1, q3, qd = F.sum(F.when(cells == 1, n).otherwise(0)), F.sum(F.when(cells == 3, n).otherwise(0)), F.sum(F.when(code.isin(6, 9), n).otherwise(0))
    return codes.agg((F.sum(cells * n) / 4).alias("area"), (F.sum(edges * n) / 2).alias("perimeter"), ((q1 - q3 + 2 * qd) / 4).alias("euler4"))


def remove_steps(df: DataFrame, value: str, order: str, by: Sequence[str], width: int) -> DataFrame:
    """Values without short steps. A step is a change of at least one population deviation of the group; if within ``width`` rows the values come back to less than that from the one before the step, the rows between take that value.

    A scan of each group's sorted rows; its last ``width`` rows begin no step.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        v, i = rows[value].to_numpy(copy=True), 1
        least = float(np.std(v)) if len(v) else 0.0
        while i < len(v) - width:
            if abs(v[i] - v[i - 1]) < least:
                i += 1
                continue
            back = np.flatnonzero(np.abs(v[i : i + width] - v[i - 1]) < least)
            n = int(back[0]) if len(back) else width
            if len(back):
                v[i : i + n] = v[i - 1]
            i += n + 1
        return rows.assign(**{value: v})

    return df.groupBy(*by).applyInPandas(scan, df.schema)


def normalise_slices(grid: DataFrame, axis: str, value: str, low: float = 0.4, high: float = 0.95, half: int = 3) -> DataFrame:
    """Values scaled by their slice's two quantiles, themselves smoothed over neighbouring slices, to those of the whole."""
    q = grid.groupBy(axis).agg(F.percentile(value, [low, high]).alias("q"))
    near = Window.orderBy(axis).rowsBetween(-half, half)  # one row per slice
    smooth = q.select(axis, F.avg(F.col("q")[0]).over(near).alias("a"), F.avg(F.col("q")[1]).over(near).alias("b"))
    level = beside_one(smooth, F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    return grid.join(level, axis).withColumn(value, (F.col(value) - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * (F.col("mb") - F.col("ma")) + F.col("ma")).drop("a", "b", "ma", "mb")


def on_grid(other: DataFrame, axes: Sequence[str], scale: Sequence[float], origin: Sequence[float]) -> DataFrame:
    """Cells of another grid moved to the nearest index of this one: index' = round(index * scale + origin)."""
    return other.withColumns({a: F.floor(F.col(a) * s + o + 0.5).cast("bigint") for a, s, o in zip(axes, scale, origin, strict=True)})


def mask(grid: DataFrame, value: str, inside: Column, fill: float, keep_inside: bool = True) -> DataFrame:
    return grid.withColumn(value, F.when(inside if keep_inside else ~inside, F.col(value)).otherwise(F.lit(fill)))


def crop(grid: DataFrame, bounds: dict[str, tuple[int, int]], pad: int = 0) -> DataFrame:
    for axis, (lo, hi) in bounds.items():
        grid = grid.where(F.col(axis).between(lo - pad, hi + pad))
    return grid


def modal_row(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """The most frequent row of rounded values, the least of equals."""
    rows = df.select(*[F.round(c, digits).alias(c) for c in columns])
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(1)
