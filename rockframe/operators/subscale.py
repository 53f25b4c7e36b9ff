"""Capillary radii of unresolved throats: models of what lies below the scale of the picture."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rockframe.functions.classify import capillary_radius

#: Bins of the distribution of sub-scale porosity; least throat radius of a curve; steps of the tabulated distributions.
BINS, LEAST_RADIUS, STEPS = 99, 1e-8, 4096


def interpolated(at: Column, x: Sequence[float], y: Sequence[float]) -> Column:
    """Linear between points of ascending x, the end values outside; of equal x the last counts."""
    xs, ys = F.array(*[F.lit(float(v)) for v in x]), F.array(*[F.lit(float(v)) for v in y])
    i = F.size(F.filter(xs, lambda v: v <= at))
    x0, x1, y0, y1 = (F.get(a, i + d) for a in (xs, ys) for d in (-1, 0))
    return F.when(i == 0, F.lit(float(y[0]))).when(i == len(x), F.lit(float(y[-1]))).otherwise(y0 + (at - x0) / (x1 - x0) * (y1 - y0))


def fixed_radius(radius: float) -> Column:
    return F.lit(float(radius))


def truncated_gaussian(key: Column, mean: float, deviation: float, low: float, high: float, seed: int = 0, log: bool = False) -> Column:
    """A radius drawn for each key from a normal distribution cut at low and high, of its logarithm to ten if ``log``.

    The draw depends on key and seed alone, so a repeated task draws the same.
    The inverse distribution is tabulated in ``STEPS`` steps of probability.
    """
    at = math.log10 if log else float
    n = NormalDist(at(mean), deviation)
    a, b = n.cdf(at(low)), n.cdf(at(high))
    table = [n.inv_cdf(min(max(a + (b - a) * (i + 0.5) / STEPS, 1e-15), 1 - 1e-15)) for i in range(STEPS)]
    value = F.get(F.array(*[F.lit(v) for v in table]), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(STEPS)).cast("int"))
    return F.pow(F.lit(10.0), value) if log else value


def porosity_distribution(throats: DataFrame, porosity: str) -> tuple[list[float], list[float]]:
    """(x, y): left edges of ``BINS`` even bins of the throats' porosity and the cumulative share up to each. 99 counts reach the driver."""
    lo, hi = throats.agg(F.min(porosity), F.max(porosity)).first()
    if lo is None:
        return [0.0], [1.0]
    lo, hi = (float(lo) - 0.5, float(hi) + 0.5) if lo == hi else (float(lo), float(hi))
    at = F.least(F.floor((F.col(porosity) - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1)).cast("int")
    counts = {r["b"]: r["n"] for r in throats.where(F.col(porosity).isNotNull()).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, up, y = sum(counts.values()), 0, []
    for i in range(BINS):
        up += counts.get(i, 0)
        y.append(up / total)
    return [lo + (hi - lo) / BINS * i for i in range(BINS)], y


def _cumulative(x: Sequence[float], y: Sequence[float]) -> tuple[list[float], list[float]]:
    points, up, out = sorted(zip(x, y, strict=True)), 0.0, []
    for _, v in points:
        up += v
        out.append(up)
    return [p for p, _ in points], [v / up for v in out]


def curve_radius(throats: DataFrame, porosity: str, pressures: Sequence[float], shares: Sequence[float]) -> Column:
    """Radius of each throat: its place among all throats' porosities is its place in the curve of pressures, whose radius it gets."""
    px, py = porosity_distribution(throats, porosity)
    cx, cy = _cumulative(pressures, shares)
    return capillary_radius(interpolated(interpolated(F.col(porosity), px, py), cy, cx))


def throat_curve_radius(throats: DataFrame, porosity: str, radii: Sequence[float], shares: Sequence[float], cutoff: float, spacing: float) -> Column:
    """As ``curve_radius``, from throat radii up to ``cutoff``: none leaves half the spacing, one that radius."""
    own = [(r, s) for r, s in zip(radii, shares, strict=True) if LEAST_RADIUS < r <= cutoff]
    if len(own) < 2:
        return F.lit(own[0][0] if own else spacing / 2)
    return curve_radius(throats, porosity, [pressure(r) for r, _ in own], [s for _, s in own])


def pressure(radius: float, tension: float = 0.48, angle: float = 140.0) -> float:
    """Entry pressure of mercury; pressure and radius are inverse to each other (``capillary_radius``)."""
    return 2 * tension * abs(math.cos(math.radians(angle))) / radius


def leverett_pressures(j: Sequence[float], porosity: float, permeability: float | None = None, corey: tuple[float, float] | None = None) -> list[float]:
    """Pressures of a dimensionless curve: from a sample's permeability, or from a phi ** b."""
    scale = math.sqrt(corey[0] * porosity ** corey[1] / porosity) if corey else permeability / porosity
    return [v / 2 * pressure(scale) for v in j]


def leverett_radius(throats: DataFrame, porosity: str, pressures: Sequence[float], saturations: Sequence[float], least_resolved: float) -> Column:
    """As ``curve_radius``, of the pressures from that of the least resolved radius on; without any, the radius of that pressure."""
    top = pressure(least_resolved)
    own = [(p, s) for p, s in zip(pressures, saturations, strict=True) if p >= top]
    return curve_radius(throats, porosity, [p for p, _ in own], [s for _, s in own]) if own else F.lit(least_resolved)
