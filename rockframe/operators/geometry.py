"""Shape of labelled objects: counts and moments by Spark, hulls and calipers by vectorised kernels per object."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.operators.aggregates import moments
from rockframe.operators.tables import row_numbers


def hull_2d(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counter-clockwise (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def calipers(corners: np.ndarray) -> tuple[float, float, float, float]:
    """Largest and smallest distance between the two corners extreme in x over 360 turns by half a degree, and their angles.

    It is the distance of these corners, not the projected width.
    """
    c = corners - corners.mean(0)
    turn = np.radians(np.arange(360) * 0.5)
    x = c[:, :1] * np.cos(turn) - c[:, 1:] * np.sin(turn)
    lo, hi = x.argmin(0), x.argmax(0)
    d = np.hypot(*(corners[hi] - corners[lo]).T)
    a, b = int(d.argmax()), int(d.argmin())
    angle = lambda k: math.atan2(*(corners[hi[k]] - corners[lo[k]])[::-1])
    return float(d[a]), float(d[b]), angle(a), angle(b)


def _ellipse_e(m: float) -> float:
    """Complete elliptic integral of the second kind, by the arithmetic-geometric mean."""
    if m >= 1:
        return 1.0
    a, b, c, s, p = 1.0, math.sqrt(1 - m), math.sqrt(m), m / 2, 1.0
    while abs(c) > 1e-15:
        a, b, c = (a + b) / 2, math.sqrt(a * b), (a - b) / 2
        s += p * c * c
        p *= 2
    return math.pi / (2 * a) * (1 - s)


SHAPE_2D = ["voxelCount", "area", "angle", "max_feret", "min_feret", "aspect_ratio", "elongation", "eccentricity", "ellipse_perimeter", "ellipse_area", "ellipse_perimeter_over_ellipse_area", "perimeter", "perimeter_over_area", "gamma"]


def shape_2d(points: np.ndarray, spacing: tuple[float, float]) -> dict[str, float] | None:
    """Attributes of one object from its pixels (y, x in units of pixels); None if fewer than three dense pixels are left."""
    near = 1.75 * min(spacing)
    p = points * np.array(spacing)
    keys = {tuple(q) for q in points.tolist()}
    ry, rx = (int(near // s) for s in spacing)
    reach = [(a, b) for a in range(-ry, ry + 1) for b in range(-rx, rx + 1) if math.hypot(a * spacing[0], b * spacing[1]) <= near]
    dense = np.array([sum((y + a, x + b) in keys for a, b in reach) >= 3 for y, x in points.tolist()], bool)
    p = p[dense]
    if len(p) < 3:
        return None
    h = hull_2d(p)
    if len(h) < 3:
        return None
    big, small, angle, _ = calipers(h)
    area = len(p) * spacing[0] * spacing[1]
    perimeter = float(np.hypot(*(h - np.roll(h, 1, 0)).T).sum())
    aspect = small / big
    ecc = math.sqrt(max(0.0, 1 - aspect))
    e_area, e_perimeter = math.pi * big * small, 4 * (big / 2) * _ellipse_e(ecc**2)
    degrees = math.degrees(angle) + (180 if angle < 0 else 0)
    degrees = (degrees + 180) % 360 if 90 < degrees < 270 else degrees
    values = [len(p), area, degrees, big, small, aspect, math.sqrt(big / small) if small else 0.0, ecc, e_perimeter, e_area, e_perimeter / e_area if e_area else 0.0, perimeter, perimeter / area, perimeter / (2 * math.sqrt(math.pi * area))]
    return dict(zip(SHAPE_2D, map(float, values), strict=True))


def object_shapes_2d(grid: DataFrame, label: str = "label", spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """One row of attributes per non-zero label of a grid (y, x, label); objects too small for a hull are dropped."""

    def one(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        got = shape_2d(pixels[["y", "x"]].to_numpy(np.float64), spacing)
        return pd.DataFrame([{"label": key[0], **got}] if got else [], columns=["label", *SHAPE_2D])

    schema = f"label {grid.schema[label].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in SHAPE_2D)
    return grid.where(F.col(label) != 0).select(F.col(label).alias("label"), "y", "x").groupBy("label").applyInPandas(one, schema)


SHAPE_3D = ["volume", "axis_1", "axis_2", "axis_3", "aspect_ratio", "elongation", "flatness", "ellipsoid_volume", "sphere_diameter"]


def object_shapes_3d(grid: DataFrame, label: str = "label", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Volumes and principal axes per label of (z, y, x, label). Spark sums the covariances; the kernel sees one row per label.

    Labels with an axis of zero length are dropped.
    """
    scaled = grid.select(F.col(label).alias("label"), *[(F.col(a) * s).alias(a) for a, s in zip("zyx", spacing, strict=True)])
    m = moments(scaled, "label", ["z", "y", "x"])

    def axes(frames):
        for f in frames:
            c = np.empty((len(f), 3, 3))
            for i, a in enumerate("zyx"):
                for j, b in enumerate("zyx"):
                    c[:, i, j] = f[f"cov_{a}{b}"] if f"cov_{a}{b}" in f else f[f"cov_{b}{a}"]
            ok = np.isfinite(c).all((1, 2))
            f, c = f[ok], c[ok]
            a = np.sqrt(np.maximum(np.linalg.eigvalsh(c), 0)) if len(c) else np.zeros((0, 3))
            keep = (a > 1e-9).all(1)
            f, a = f[keep], a[keep]
            v = f["n"].to_numpy() * np.prod(spacing)
            yield pd.DataFrame(dict(zip(["label", "n", *SHAPE_3D], [f["label"], f["n"], v, a[:, 0], a[:, 1], a[:, 2], a[:, 0] / a[:, 2], a[:, 2] / a[:, 1], a[:, 1] / a[:, 0], 4 / 3 * math.pi * np.prod(a / 2, 1), (6 * v / math.pi) ** (1 / 3)], strict=True)))

    return m.mapInPandas(axes, f"label {grid.schema[label].dataType.simpleString()}, n bigint, " + ", ".join(f"{c} double" for c in SHAPE_3D))


def report_order(report: DataFrame, min_feret: float = 0.0) -> DataFrame:
    """Rows with max_feret of at least the threshold, rounded to five digits, relabelled 1, 2 ... by falling size, diameter and label."""
    doubles = [f.name for f in report.schema if f.dataType.typeName() == "double"]
    kept = report.dropna().where(F.col("max_feret") >= min_feret).withColumns({c: F.round(c, 5) for c in doubles})
    return row_numbers(kept, [F.desc("voxelCount"), F.desc("max_feret"), F.desc("label")], "new_label")
