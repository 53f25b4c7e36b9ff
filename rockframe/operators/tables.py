"""Filters, sorts, selections and set operations on instance tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rockframe.runtime import materialize


@dataclass
class Rule:
    """Values from low to high, both inclusive, or equal to a value; an invisible rule doesn't count."""

    low: float | None = None
    high: float | None = None
    equals: object = None
    visible: bool = True

    def on(self, column: Column, kind: T.DataType) -> Column:
        if self.equals is not None:
            return F.coalesce(column == F.lit(str(self.equals)).try_cast(kind), F.lit(False))
        return F.coalesce(column.between(self.low, self.high), F.lit(False))


@dataclass
class Filter:
    column: str
    rules: list[Rule] = field(default_factory=list)


def predicate(df: DataFrame, filters: Sequence[Filter]) -> Column:
    """All filters, any rule of each; a filter without a visible rule matches nothing."""
    ors = [reduce(lambda a, b: a | b, [r.on(F.col(f.column), df.schema[f.column].dataType) for r in f.rules if r.visible], F.lit(False)) for f in filters]
    return reduce(lambda a, b: a & b, ors, F.lit(True))


def filter_rows(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return df.where(predicate(df, filters))


def relabel(df: DataFrame, classes: Sequence[Sequence[Filter]], to: str = "label") -> DataFrame:
    """Class i + 1 of the last of ``classes`` that matches, 0 for none."""
    out = F.lit(0)
    for i, c in enumerate(classes, 1):
        out = F.when(predicate(df, c), i).otherwise(out)
    return df.withColumn(to, out)


def default_filter(df: DataFrame, column: str) -> DataFrame:
    """(low, high) of a column of floats; else its distinct values, ascending."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def first_seen_codes(df: DataFrame, value: str, order: str, to: str = "code") -> DataFrame:
    """Codes from 1 in the order in which values first occur. The ranking runs over distinct values alone."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    codes = row_numbers(first, ["_first", value], to).drop("_first")
    return df.join(codes, value)


def export_selection(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != 0).withColumn("segmented_by", F.lit(by))


def within_fraction(df: DataFrame, targets: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie within target +- target * fraction."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(t - t * f, t + t * f) for c, (t, f) in targets.items()], F.lit(True)))


def within_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside all inclusive ranges; unknown columns are ignored."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(*r) for c, r in ranges.items() if c in df.columns], F.lit(True)))


def beside_one(df: DataFrame, *aggregates: Column, where: Column | None = None) -> DataFrame:
    """``df`` with aggregates over all of it (or of its rows ``where``) beside each row: a broadcast of one row."""
    return df.crossJoin(F.broadcast((df if where is None else df.where(where)).agg(*aggregates)))


def sigma_filter(df: DataFrame, column: str, n: float) -> DataFrame:
    """Rows within mean +- n population standard deviations."""
    both = beside_one(df, F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return both.where(F.abs(F.col(column) - F.col("_m")) <= n * F.col("_s")).drop("_m", "_s")


def winsorise(df: DataFrame, column: str, n: float = 3.0) -> DataFrame:
    """Values beyond n population deviations moved to that bound, upper side first; the lower side sees the moved values. Nulls become the mean."""
    for side in (1, -1):
        both = beside_one(df, F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
        bound = F.col("_m") + side * n * F.col("_s")
        df = both.withColumn(column, F.when(F.col(column).isNotNull(), (F.least if side > 0 else F.greatest)(F.col(column), bound))).drop("_m", "_s")
    return beside_one(df, F.avg(column).alias("_m")).withColumn(column, F.coalesce(column, "_m")).drop("_m")


def nulls(df: DataFrame, columns: Sequence[str], sentinels: Sequence[float]) -> DataFrame:
    """Sentinel values and NaN become null."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels) & ~F.isnan(F.col(c).cast("double")), F.col(c)) for c in columns})


def trim_nulls(df: DataFrame, column: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows from the first to the last non-null value."""
    ends = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    return joined.where(F.col(order).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def cast_numeric(df: DataFrame) -> DataFrame:
    """String columns of which every non-null cell is a number become doubles; one bad cell keeps the column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    bad = df.agg(*[F.coalesce(F.max(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()), F.lit(False)).alias(c) for c in text]).first()
    return df.withColumns({c: F.col(c).cast("double") for c in text if not bad[c]})


def transpose(df: DataFrame) -> DataFrame:
    """The first column's values become column names. For tables of a size to be looked at: the header is one distinct query."""
    head, rest = df.columns[0], df.columns[1:]
    long = df.unpivot([head], rest, "name", "value")
    names = [r[0] for r in df.select(head).distinct().orderBy(head).collect()]
    return long.groupBy("name").pivot(head, names).agg(F.first("value"))


def top_k(df: DataFrame, k: int, score: str, by: Sequence[str], ties: str) -> DataFrame:
    """The k rows of each group with the highest score, lowest ``ties`` first among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(ties))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def even_sample(df: DataFrame, order: str, at_most: int, keep_max: str | None = None) -> DataFrame:
    """At most ``at_most`` evenly spaced rows by ``order`` (and the rows with the largest ``keep_max``).

    Row numbers come from a range partitioning: counts per bucket, then ranks
    inside each, so no task sees all rows. ``order`` must be unique.
    """
    numbered = global_row_number(df, order)
    both = beside_one(numbered, F.count(F.lit(1)).alias("_n"), *([F.max(keep_max).alias("_x")] if keep_max else []))
    step = F.greatest(F.lit(1), F.expr(f"(_n + {at_most - 1}) div {at_most}"))
    hit = (F.col("row_number") - 1) % step == 0
    return both.where(hit | (F.col(keep_max) == F.col("_x")) if keep_max else hit).drop("_n", "_x", "row_number")


def global_row_number(df: DataFrame, order: str, cells: int = 256) -> DataFrame:
    """Adds row_number, from 1 by ``order`` (a unique number), with tasks of a bucket each."""
    cuts = df.agg(F.percentile_approx(order, [i / cells for i in range(1, cells)], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else None
    placed = df.withColumn("_b", F.size(F.filter(bounds, lambda b: b <= F.col(order))) if cuts else F.lit(0))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_b").orderBy(order)
    return placed.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), "_b").withColumn("row_number", F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over all rows in ``order`` (own row included), for orders of any columns.

    Rows are dealt by range and written, each part adds up its own, and the sums
    of the parts (one row each) say where each begins. ``order`` must be unique.
    """
    cols = {to: c for to, c in sums.items()}
    dealt = df.withColumns({f"_v_{to}": c for to, c in cols.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    own, parts = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_v_{to}").alias(f"_t_{to}") for to in cols])
    begins = totals.select("_part", *[F.coalesce(F.sum(f"_t_{to}").over(parts), F.lit(0)).alias(f"_b_{to}") for to in cols])
    both = dealt.join(F.broadcast(begins), "_part")  # a row per partition
    return both.select(*df.columns, *[(F.col(f"_b_{to}") + F.sum(f"_v_{to}").over(own)).alias(to) for to in cols])


def row_numbers(df: DataFrame, order: Sequence[Column | str], to: str = "row_number") -> DataFrame:
    """Adds numbers from 1 in ``order``, which must be unique."""
    return running(df, order, {to: F.lit(1)}).withColumn(to, F.col(to).cast("int"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same keys and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def distinct_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).distinct()


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either table whose keys the other lacks; nulls equal each other."""
    def missing(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.select(*keys).distinct().alias("y")
        return x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]), "left_anti")

    return missing(a, b).unionByName(missing(b, a), allowMissingColumns=True)


def parameter_grid(spark, axes: dict[str, Sequence[float]], clamp: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """All combinations, the last axis varying fastest, numbered from 0; clamped columns stay in their range."""
    out = spark.range(1).select(F.lit(1).alias("_"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(f"_{name}", name))
    number = F.lit(0)
    for name, values in axes.items():
        number = number * len(values) + F.col(f"_{name}")
    columns = [(F.least(F.greatest(F.col(c), F.lit(clamp[c][0])), F.lit(clamp[c][1])) if clamp and c in clamp else F.col(c)).alias(c) for c in axes]
    return out.select(number.cast("bigint").alias("id"), *columns)


def spaced(start: float, stop: float, steps: int, log: bool = False) -> list[float]:
    """``steps`` values from start to stop, evenly or in equal ratios; one step is the start."""
    if steps == 1:
        return [float(start)]
    at = [i / (steps - 1) for i in range(steps)]
    return [start * (stop / start) ** t for t in at] if log else [start + (stop - start) * t for t in at]
