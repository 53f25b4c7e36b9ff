"""Counts, statistics and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.operators.tables import beside_one, running


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, total): counts of labels except 0; total is all rows, 0 included."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return beside_one(counts, F.sum("n").alias("total")).where(F.col(label) != 0)


def proportions(df: DataFrame, by: str, digits: int, scale: float = 100.0, where: Column | None = None) -> DataFrame:
    """(by, n, share): each value's share of all rows (or of those ``where``)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    both = beside_one(counts, F.sum("n").alias("_t"), where=where)
    return (both if where is None else both.where(where)).select(by, "n", F.round(scale * F.col("n") / F.col("_t"), digits).alias("share"))


def group_statistics(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """mean, median, std (sample, 0 for one row), max, min, quantity and percentage of each group."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.count(F.lit(1)).alias("quantity"),
    )
    both = beside_one(stats, F.sum("quantity").alias("_t")).withColumn("percentage", 100.0 * F.col("quantity") / F.col("_t"))
    return both.select(*by, *[F.round(c, digits).alias(c) for c in ("mean", "median", "std", "max", "min")], "quantity", F.round("percentage", digits).alias("percentage"))


def weighted_mean(df: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str) -> DataFrame:
    """sum(x w) / sum(w) of each column."""
    return df.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col(weight))), F.lit(0))).alias(c) for c in columns])


def moduli(df: DataFrame, by: Sequence[str], value: str, fraction: str) -> DataFrame:
    """(voigt, reuss): arithmetic and harmonic means under fractions that sum to 1."""
    return df.groupBy(*by).agg(F.sum(F.col(fraction) * F.col(value)).alias("voigt"), (1 / F.sum(F.col(fraction) / F.col(value))).alias("reuss"))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None, weight: str | None = None) -> DataFrame:
    """(bin, low, high, y): ``bins`` equal bins from the least to the greatest value (or fixed bounds), the last one closed, empty ones kept."""
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(v.cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")) if low is None else df.sparkSession.range(1).select(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    placed = rows.crossJoin(F.broadcast(ends)).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    own = placed.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("w").alias("y"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    return frame.join(F.broadcast(own), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("y", F.lit(0.0)).alias("y"))


def depth_histogram(df: DataFrame, depth: str, value: str, bins: int, weight: str | None = None, height: float | None = None) -> DataFrame:
    """(depth, bin, x, y): geometric bins shared by all depths, x their geometric centres, empty bins kept.

    y is divided by the depth's sum, or, given ``height``, scaled so that its
    maximum is the height. Values and the least value must be positive.
    """
    rows = df.where(F.col(value) > 0).select(F.col(depth).alias("d"), F.col(value).cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("ratio", F.log(F.col("hi") / F.col("lo")) / bins)
    at = F.least(F.floor(F.log(F.col("v") / F.col("lo")) / F.col("ratio") + 1e-9), F.lit(bins - 1)).cast("int")
    own = rows.crossJoin(F.broadcast(ends)).groupBy("d", at.alias("bin")).agg(F.sum("w").alias("n"))
    frame = own.select("d").distinct().crossJoin(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))).crossJoin(F.broadcast(ends))
    full = frame.join(own, ["d", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    per = Window.partitionBy("d")
    y = F.col("n") / F.nullif(F.sum("n").over(per), F.lit(0)) if height is None else F.col("n") * height / F.nullif(F.max("n").over(per), F.lit(0))
    return full.select(F.col("d").alias(depth), "bin", (F.col("lo") * F.exp(F.col("ratio") * (F.col("bin") + 0.5))).alias("x"), y.alias("y"))


def value_cdf(df: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, cdf) over distinct values, ascending."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    if not by:  # all distinct values are one group
        total = beside_one(running(counts, [value], {"_up": F.col("n")}), F.sum("n").alias("_all"))
        return total.select(value, "n", (F.col("_up") / F.col("_all")).alias("cdf"))
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cdf", F.sum("n").over(up) / F.sum("n").over(Window.partitionBy(*by)))


def cdf_marker(cdf: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the value at cdf = q, linear between neighbours, clamped at the ends."""
    w = Window.orderBy(value)
    pairs = cdf.select(value, "cdf", F.lag("cdf").over(w).alias("c0"), F.lag(value).over(w).alias("v0"))
    hit = pairs.where(F.col("cdf") >= q).agg(F.min_by(F.struct(value, "cdf", "c0", "v0"), value).alias("h")).select("h.*")
    lerp = F.col("v0") + (q - F.col("c0")) / (F.col("cdf") - F.col("c0")) * (F.col(value) - F.col("v0"))
    return hit.select(F.lit(q).alias("q"), F.coalesce(lerp, F.col(value).cast("double")).alias("marker"))


def otsu(df: DataFrame, value: str) -> DataFrame:
    """(threshold, variance): the value that parts values <= it from the rest with the largest variance between."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("n"))
    up = running(counts, [value], {"w0": F.col("n"), "s0": F.col("n") * F.col(value)})
    sums = beside_one(up, F.sum("n").alias("w"), F.sum(F.col("n") * F.col(value)).alias("s"))
    w0, w1 = F.col("w0"), F.col("w") - F.col("w0")
    between = w0 * w1 * F.pow(F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1, 2) / (F.col("w") * F.col("w"))
    return sums.where(w1 > 0).select(F.col(value).alias("threshold"), between.alias("variance")).orderBy(F.desc(F.round("variance", 9)), "threshold").limit(1)


def equalise(df: DataFrame, value: str, to: str = "equalised") -> DataFrame:
    """Values replaced by their cumulative share."""
    return df.join(value_cdf(df, value).select(value, F.col("cdf").alias(to)), value)


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair, of the rows that have both; one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    one = df.agg(*[both(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(slope, intercept, r2, n) of the least-squares line."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def moments(df: DataFrame, label: str, axes: Sequence[str]) -> DataFrame:
    """Per label: count, centroid and the sample covariance of each pair of axes."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return df.where(F.col(label) != 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in axes], *[F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def inertia(df: DataFrame, label: str, axes: tuple[str, str, str], weight: str | None = None) -> DataFrame:
    """Per label: the six entries of the inertia tensor about the centroid, divided by the weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    x, y, z = (F.col(a) for a in axes)
    sums = df.groupBy(label).agg(F.sum(w).alias("w"), *[(F.sum(w * a) / F.sum(w)).alias(f"m{i}") for i, a in enumerate((x, y, z))], *[(F.sum(w * a * b) / F.sum(w)).alias(n) for n, a, b in (("xx", x, x), ("yy", y, y), ("zz", z, z), ("xy", x, y), ("xz", x, z), ("yz", y, z))])
    m = lambda n, i, j: F.col(n) - F.col(f"m{i}") * F.col(f"m{j}")
    xx, yy, zz = m("xx", 0, 0), m("yy", 1, 1), m("zz", 2, 2)
    return sums.select(label, "w", (yy + zz).alias("ixx"), (xx + zz).alias("iyy"), (xx + yy).alias("izz"), (-m("xy", 0, 1)).alias("ixy"), (-m("xz", 0, 2)).alias("ixz"), (-m("yz", 1, 2)).alias("iyz"))


def mode_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"), F.max("n").alias("n"))


def conditional_bins(df: DataFrame, value: str, conditions: dict[str, object]) -> DataFrame:
    """(bin, n): counts of a small non-negative integer where all equalities hold, for 0 to the largest value, empty ones kept."""
    hit = df
    for c, v in conditions.items():
        hit = hit.where(F.col(c) == v)
    own = hit.groupBy(F.col(value).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = df.agg(F.max(value).cast("bigint").alias("m"))
    frame = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("bin"))
    return frame.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Subtotals over all prefixes of ``by`` (rollup), with exact and approximate distinct counts."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("distinct"), F.approx_count_distinct(value, 0.02).alias("approximate"))
