"""Clusters and fits. Sums are taken by Spark; what is solved on the driver has a size that doesn't grow with the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.operators.components import connected_components


def kmeans_thresholds(df: DataFrame, value: str, k: int = 3, rounds: int = 50) -> list[float]:
    """Upper bounds of k classes of one column, the last being its maximum.

    Lloyd's algorithm from evenly spaced quantiles, on counts of rounded values
    (at most 4096 rows), so every value of the table takes part.
    """
    ends = df.agg(F.min(value), F.max(value)).first()
    if ends[0] is None:
        return []
    lo, width = float(ends[0]), max((float(ends[1]) - float(ends[0])) / 4096, 1e-300)
    cell = F.least(F.floor((F.col(value) - lo) / width), F.lit(4095))
    rows = np.array([tuple(r) for r in df.where(F.col(value).isNotNull()).groupBy(cell.alias("c")).agg(F.count(F.lit(1)), F.avg(value), F.max(value)).orderBy("c").collect()], float)
    n, x, top = rows[:, 1], rows[:, 2], rows[:, 3]
    c = np.interp((np.arange(k) + 0.5) / k, np.cumsum(n) / n.sum(), x)
    for _ in range(rounds):
        to = np.abs(x[:, None] - c).argmin(1)
        new = np.array([np.average(x[to == j], weights=n[to == j]) if (to == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return sorted(float(top[to == j].max()) for j in np.argsort(c) if (to == j).any())


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 5932, to: str = "cluster") -> DataFrame:
    """Clusters of rows by several columns, numbered from 1 by their largest first feature."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    out = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_p").fit(rows).transform(rows).drop("_v")
    order = {r["_p"]: i for i, r in enumerate(out.groupBy("_p").agg(F.max(features[0]).alias("m")).orderBy("m").collect(), 1)}  # k rows
    code = F.lit(0)
    for p, i in order.items():
        code = F.when(F.col("_p") == p, i).otherwise(code)
    return out.withColumn(to, code).drop("_p")


def forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 8, depth: int = 6, seed: int = 12345):
    """A fitted random forest over feature columns; ``model.transform`` adds predictions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v"), RandomForestClassifier(labelCol=label, featuresCol="_v", numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def timur_coates_fit(df: DataFrame, phi: str, k: str, c: float = 0.0) -> dict[str, float]:
    """A and B of A (phi - C)^B for a fixed C: a line in logarithms, by one aggregate."""
    rows = df.where((F.col(phi) > c) & (F.col(k) > 0))
    r = rows.agg(F.regr_slope(F.log(k), F.log(F.col(phi) - c)).alias("b"), F.regr_intercept(F.log(k), F.log(F.col(phi) - c)).alias("a")).first()
    return {"A": math.exp(r["a"]) if r["a"] is not None else float("nan"), "B": r["b"], "C": c}


def response_surface(df: DataFrame, inputs: Sequence[str], target: str) -> dict[str, float]:
    """Coefficients of the second-order polynomial, by normal equations summed in one pass."""
    terms: list[tuple[str, ...]] = [()] + [(a,) for a in inputs] + [(a, b) for i, a in enumerate(inputs) for b in inputs[i:]]
    product = lambda t: math.prod([F.col(c) for c in t], start=F.lit(1.0))
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = df.agg(*[F.sum(product(terms[i]) * product(terms[j])) for i, j in pairs], *[F.sum(product(t) * F.col(target)) for t in terms]).first()
    a = np.zeros((len(terms),) * 2)
    for (i, j), s in zip(pairs, sums, strict=False):
        a[i, j] = a[j, i] = s
    b = np.array(sums[len(pairs) :], float)
    return {"*".join(t) or "1": float(v) for t, v in zip(terms, np.linalg.lstsq(a, b, rcond=None)[0], strict=True)}


def anova(df: DataFrame, factors: Sequence[str], target: str) -> dict[str, tuple[float, int]]:
    """(sum of squares, degrees of freedom) that each numeric factor and each pair explains beyond all others (type III)."""
    names: list[tuple[str, ...]] = [(a,) for a in factors] + [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    terms = [(), *names]
    product = lambda t: math.prod([F.col(c) for c in t], start=F.lit(1.0))
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    s = df.agg(*[F.sum(product(terms[i]) * product(terms[j])) for i, j in pairs], *[F.sum(product(t) * F.col(target)) for t in terms], F.sum(F.col(target) * F.col(target))).first()
    a = np.zeros((len(terms),) * 2)
    for (i, j), v in zip(pairs, s, strict=False):
        a[i, j] = a[j, i] = v
    b, yy = np.array(s[len(pairs) : -1], float), float(s[-1])

    def residual(keep: list[int]) -> float:
        x = np.linalg.lstsq(a[np.ix_(keep, keep)], b[keep], rcond=None)[0]
        return yy - float(x @ b[keep])

    every = list(range(len(terms)))
    full = residual(every)
    return {"*".join(t): (residual([j for j in every if j != i]) - full, 1) for i, t in enumerate(names, 1)}


def permeability(network: list[tuple[int, int, float]], inlet: set[int], outlet: set[int], drop: float = 1.0) -> tuple[float, dict[int, float]]:
    """Flow and pressures of one network: conductances g between pores, fixed pressure on both faces, conjugate gradients.

    For the network of one sample, as a driver step after ``clusters`` has kept
    what spans both faces.
    """
    ids = sorted({x for a, b, _ in network for x in (a, b)})
    free = {p: i for i, p in enumerate(x for x in ids if x not in inlet and x not in outlet)}
    fixed = lambda p: drop if p in inlet else 0.0
    diag, rhs = np.zeros(len(free)), np.zeros(len(free))
    inner = []
    for a, b, g in network:
        for p, q in ((a, b), (b, a)):
            if p in free:
                diag[free[p]] += g
                if q not in free:
                    rhs[free[p]] += g * fixed(q)
        if a in free and b in free:
            inner.append((free[a], free[b], g))
    i, j, w = (np.array(c) for c in zip(*inner, strict=True)) if inner else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    apply = lambda x: diag * x - np.bincount(i, w * x[j], len(x)) - np.bincount(j, w * x[i], len(x))
    x, r = np.zeros(len(free)), rhs.copy()
    p, rr = r.copy(), float(r @ r)
    for _ in range(10 * len(free) + 10):
        if rr < 1e-24 * max(1.0, float(rhs @ rhs)):
            break
        ap = apply(p)
        step = rr / float(p @ ap)
        x, r = x + step * p, r - step * ap
        rr, old = float(r @ r), rr
        p = r + rr / old * p
    pressure = {q: (float(x[free[q]]) if q in free else fixed(q)) for q in ids}
    flow = sum(g * (pressure[a] - pressure[b]) * (1 if a in inlet else -1) for a, b, g in network if (a in inlet) != (b in inlet))
    return flow, pressure


def intrusion(pores: DataFrame, throats: DataFrame, pressures: Sequence[float]) -> DataFrame:
    """(pressure, invaded): volume reached from inlet pores through throats whose entry pressure is passed.

    pores: pore, volume, inlet; throats: a, b, entry. Each pressure is a
    component search over the open throats.
    """
    out = None
    for p in pressures:
        comps = connected_components(throats.where(F.col("entry") <= p), "a", "b").withColumnRenamed("id", "pore")
        placed = pores.join(comps, "pore", "left")
        reached = placed.where("inlet AND component IS NOT NULL").select("component").distinct()
        wet = placed.join(reached.withColumn("hit", F.lit(True)), "component", "left").where("inlet OR hit")
        one = wet.agg(F.lit(float(p)).alias("pressure"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("invaded"))
        out = one if out is None else out.unionByName(one)
    return out
