"""Masks of labels, statistics beside null values, exclusion lists and parameter sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.functions.classify import half_open_classes
from rockframe.operators.tables import beside_one


def mask_of(label: Column, targets: Sequence[int], placeholder: int = 1) -> Column:
    """``placeholder`` where the label is one of the targets, else 0."""
    return F.when(label.isin(*targets), F.lit(placeholder)).otherwise(F.lit(0))


def zero_below(value: Column, least: float, placeholder: float = 0) -> Column:
    """Values below ``least`` become the placeholder."""
    return F.when(value < least, F.lit(placeholder)).otherwise(value)


def merged(label: Column, labels: Sequence[int] | None = None) -> Column:
    """True where the label is one of ``labels``, or any but 0."""
    return label != 0 if labels is None else label.isin(*labels)


def valid_stats(df: DataFrame, value: str, null_values: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, n, min, max, mean, std): of values that are neither null, NaN nor one of ``null_values``; std is that of a sample."""
    v = F.col(value).cast("double")
    good = df.where(v.isNotNull() & ~F.isnan(v) & (~v.isin(*map(float, null_values)) if null_values else F.lit(True)))
    return good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def without_listed(df: DataFrame, excluded: DataFrame, on: str, limits: DataFrame | None = None, limit: str = "limit") -> DataFrame:
    """Rows whose key is not listed, with the limit that another list has for it (null where it has none)."""
    left = df.join(excluded.select(on).distinct(), on, "left_anti")
    return left if limits is None else left.join(limits.select(on, limit), on, "left")


def centre_histogram(df: DataFrame, value: str, centres: Sequence[float | None]) -> DataFrame:
    """(bin, low, high, n): counts between edges half way between centres; null and repeated centres are dropped.

    The outer edges lie as far beyond the outer centres as the inner ones lie
    inside. Bins hold their left edge, the last one both. Fewer than two
    centres give no row.
    """
    c = sorted({float(x) for x in centres if x is not None and x == x})
    edges = [c[0] - (c[1] - c[0]) / 2, *[(a + b) / 2 for a, b in zip(c, c[1:], strict=False)], c[-1] + (c[-1] - c[-2]) / 2] if len(c) > 1 else []
    spark = df.sparkSession
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    v = F.col(value).cast("double")
    at = F.when(v.between(edges[0], edges[-1]), F.least(half_open_classes(v, edges) - 1, F.lit(len(c) - 1))) if edges else F.lit(None).cast("int")
    counts = df.select(at.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "bin", "left").fillna(0, ["n"])


def parameter_sets(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, sets): the rows of each combination of keys as structs, in their order. A set list is as long as its sweep."""
    rest = [c for c in df.columns if c not in keys]
    inner = [order, *[c for c in rest if c != order]]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("sets"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, count, mean, std, min, q25, q50, q75, max) of numeric columns, nulls left out; quantiles between rows are linear."""
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.max(c).cast("double").alias("max"))
    return df.groupBy(*by).agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(*by, F.explode("_s").alias("_r")).select(*by, "_r.*")


def zoom_limits(df: DataFrame, value: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """One row (low, high) of percentiles, linear between rows."""
    return df.agg(F.percentile(value, low / 100).alias("low"), F.percentile(value, high / 100).alias("high"))


def shared_depths(a: DataFrame, b: DataFrame, depth: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of both logs strictly inside the depths that both cover."""
    ends = [t.groupBy(*by).agg(F.min(depth).alias(f"_a{i}"), F.max(depth).alias(f"_b{i}")) for i, t in enumerate((a, b))]
    both = ends[0].join(ends[1], list(by)) if by else ends[0].crossJoin(ends[1])
    both = both.select(*by, F.greatest("_a0", "_a1").alias("_lo"), F.least("_b0", "_b1").alias("_hi"))

    def inside(t: DataFrame) -> DataFrame:
        joined = t.join(both, list(by)) if by else t.crossJoin(F.broadcast(both))
        return joined.where((F.col(depth) > F.col("_lo")) & (F.col(depth) < F.col("_hi"))).select(*t.columns)

    return inside(a), inside(b)


def same_depths(a: DataFrame, b: DataFrame, depth: str, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(by, same): whether both logs have as many depths, each within the tolerance of the other's of the same rank."""
    w = Window.partitionBy(*by).orderBy(depth)
    one = lambda t, n: t.select(*by, F.row_number().over(w).alias("_i"), F.col(depth).alias(n))
    both = one(a, "_x").join(one(b, "_y"), [*by, "_i"], "full")
    close = F.coalesce(F.abs(F.col("_x") - F.col("_y")) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs("_x"), F.abs("_y"))), F.lit(False))
    return both.groupBy(*by).agg(F.min(close).alias("same"))


def throat_ids(cells: DataFrame, throat: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, throat, id): 'a-b' of the two labels with the most cells of each throat, a < b; ids that repeat (in ``by``) get a, b, c ... behind, by throat.

    Throats with fewer than two labels but 0 have no id and no row; of labels
    with equal counts the lower goes first.
    """
    keys = [*by, throat]
    counts = cells.where(F.col(label) != 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), label))).where("_r <= 2")
    pair = top.groupBy(*keys).agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.count(F.lit(1)).alias("_k")).where("_k = 2")
    return unique_ids(pair.select(*keys, F.concat_ws("-", "_a", "_b").alias("id")), "id", throat, by)


#: Characters from a on: those before the surrogates, which are no characters of their own, and all.
_BELOW, _LETTERS = 0xD800 - 97, 0x110000 - 0x800 - 97


def letter(i: Column) -> Column:
    """a, b, c ... by character code for 1, 2, 3 ...; surrogates are passed over, and after the last character two are told (aa, ab ...)."""

    def one(k: Column) -> Column:  # k from 0
        code = k + 97 + F.when(k >= _BELOW, 0x800).otherwise(0)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    k = i.cast("bigint") - 1
    high = F.floor(k / _LETTERS)  # k is below 2^53 by far
    return F.when(k < _LETTERS, one(k)).otherwise(F.concat(one(high - 1), one(k - high * _LETTERS)))


def unique_ids(df: DataFrame, name: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Names that occur once (in ``by``) stay; the others get a, b, c ... behind (see ``letter``), in ``order``."""
    w = Window.partitionBy(*by, name)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)))
    return out.withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), letter(F.col("_i")))).otherwise(F.col(name))).drop("_n", "_i")


def porosimetry(df: DataFrame, radius: str, snw: str, fraction: float = 0.0) -> DataFrame:
    """(radius, inverse, log_inverse, snw, sw[, sws]) rounded to five digits; a sub-scale fraction corrects both saturations."""
    r, sw = F.col(radius), 1 - F.col(snw)
    right = fraction + sw * (1 - fraction)
    columns = {"radius": r, "inverse": 1 / r, "log_inverse": F.log(1 / r), "snw": 1 - right, "sw": right} | ({"sws": sw} if fraction else {})
    return df.select(*[F.round(c, 5).alias(n) for n, c in columns.items()])


def brightness_contrast(df: DataFrame, channels: Sequence[str], brightness: float, contrast: float) -> DataFrame:
    """Channels of 0 to 255 scaled by 1 + brightness / 100, then moved from the picture's mean gray by 1 + contrast / 100; whole numbers, cut at both ends.

    Gray is 0.299, 0.587 and 0.114 of three channels; the mean is rounded.
    """
    cut = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("int")
    bright = df.withColumns({c: cut(F.col(c) * (1 + brightness / 100)) for c in channels})
    gray = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(channels, (0.299, 0.587, 0.114), strict=True)]) if len(channels) == 3 else F.col(channels[0])
    both = beside_one(bright, F.floor(F.avg(gray) + 0.5).alias("_m"))
    return both.withColumns({c: cut(F.col("_m") + (F.col(c) - F.col("_m")) * (1 + contrast / 100)) for c in channels}).drop("_m")


def saturated(channels: Sequence[Column], value: float) -> list[Column]:
    """Three channels moved from their gray by 1 + value / 100."""
    gray = channels[0] * 0.299 + channels[1] * 0.587 + channels[2] * 0.114
    return [F.floor(F.least(F.greatest(gray + (c - gray) * (1 + value / 100), F.lit(0.0)), F.lit(255.0))).cast("int") for c in channels]


def windowed_cross_correlation(df: DataFrame, order: str, left: str, right: str, by: Sequence[str], width: int, step: int, lags: Sequence[int]) -> DataFrame:
    """(by, window, lag, r): per window of ``width`` rows, every ``step`` rows, the sum of left(i + lag) right(i) inside it.

    There are (n + 1 - width) div step windows of n rows, none if that is not positive.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.select(*by, F.col(left).alias("_a"), F.col(right).alias("_b"), (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_n"))
    at = Window.partitionBy(*by).orderBy("_i")
    beside = rows.select(*by, "_i", "_n", *[(F.col("_b") * (F.lead("_a", k).over(at) if k >= 0 else F.lag("_a", -k).over(at))).alias(f"_p{j}") for j, k in enumerate(lags)])
    moved = beside.select(*by, "_i", "_n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_p{j}").alias("p")) for j, k in enumerate(lags)])).alias("_s")).select(*by, "_i", "_n", "_s.*")
    lo = F.least(F.col("_i"), F.col("_i") + F.col("lag"))
    hi = F.greatest(F.col("_i"), F.col("_i") + F.col("lag"))
    first = F.greatest(F.lit(0), F.ceil((hi - (width - 1)) / step).cast("int"))
    last = F.least(F.floor(lo / step).cast("int"), F.expr(f"cast((_n + 1 - {width}) div {step} AS int)") - 1)
    found = moved.where(F.col("p").isNotNull()).withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return found.groupBy(*by, "window", "lag").agg(F.sum("p").alias("r"))
