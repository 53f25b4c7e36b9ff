"""Band, interval, as-of and nearest joins. Range predicates become equi-joins on buckets with the exact test left over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.runtime import materialize


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, delta: float, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs with |left - right| <= delta (both ends inclusive) and equal ``by``; ``how`` may be full, left or inner.

    Buckets are delta wide: a left row meets its bucket and the two beside it.
    Column names must differ but for ``by``. Both sides keep duplicates; rows
    that pair with nothing are found by a row number, so equal rows are safe;
    numbered sides are written first, since both uses must see one numbering.
    """
    a = materialize(left.withColumn("_l", F.monotonically_increasing_id())) if how != "inner" else left
    b = materialize(right.withColumn("_r", F.monotonically_increasing_id())) if how == "full" else right
    cell = lambda c: F.floor(F.col(c) / delta)
    near = a.withColumn("_cell", F.explode(F.array(*[cell(left_on) + i for i in (-1, 0, 1)])))
    hit = near.join(b.withColumn("_cell", cell(right_on)), [*by, "_cell"]).where(F.abs(F.col(left_on) - F.col(right_on)) <= delta).drop("_cell")
    if how == "inner":
        return hit
    out = hit.unionByName(a.join(hit.select("_l").distinct(), "_l", "left_anti"), allowMissingColumns=True)
    if how == "full":
        out = out.unionByName(b.join(hit.select("_r").distinct(), "_r", "left_anti"), allowMissingColumns=True)
    return out.drop("_l", "_r")


def duplicate_marks(df: DataFrame, depth: str, key: str, angle: str, delta: float, by: Sequence[str], target: float = 180.0) -> DataFrame:
    """Of each pair of marks within delta in depth, the one whose angle is nearest the target; lower key among equals.

    A mark counts as paired if exactly one other lies within delta of it.
    """
    keys = ", ".join(f"`{b}`" for b in by)  # in SQL, since the API's ranges are whole numbers
    near = f"OVER (PARTITION BY {keys} ORDER BY cast(`{depth}` AS double) RANGE BETWEEN {delta}D PRECEDING AND {delta}D FOLLOWING)"
    group = df.withColumn("_c", F.expr(f"count(`{key}`) {near}")).withColumn("_g", F.struct(F.expr(f"min(`{key}`) {near}").alias("a"), F.expr(f"max(`{key}`) {near}").alias("b")))
    twins = group.where("_c = 2")
    best = twins.groupBy(*by, "_g").agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(F.abs(F.col(angle) - target), F.col(key))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.where("n = 2").select(*by, "b.*")


def interpolate_at(curve: DataFrame, points: DataFrame, x: str, y: str, at: str, by: Sequence[str] = (), clamp: bool = True) -> DataFrame:
    """``points`` with y of the curve at ``at``: linear between the neighbours on either side, of the same ``by``.

    Outside the curve: the end value if ``clamp``, else null. Curve points and
    foreign points are sorted together, upwards and downwards (a frame that grows
    costs one step a row, one that shrinks is read again for each), so no pair of
    rows is formed.
    """
    keys = list(by)
    extra = [c for c in points.columns if c not in (*keys, at)]
    a = curve.where(F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias("_y")).select(*keys, F.col(x).cast("double").alias("_x"), "_y", F.lit(None).cast(points.select(F.struct(at, *extra).alias("p")).schema["p"].dataType).alias("_p"))
    b = points.select(*keys, F.col(at).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.struct(at, *extra).alias("_p"))
    w, down = Window.partitionBy(*keys).orderBy("_x"), Window.partitionBy(*keys).orderBy(F.desc("_x"))
    known = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    both = a.unionByName(b).withColumn("_lo", F.last(known, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last(known, True).over(down.rangeBetween(Window.unboundedPreceding, 0)))
    lo, hi = F.col("_lo"), F.col("_hi")
    inside = F.when(lo["_x"] == hi["_x"], lo["_y"]).otherwise(lo["_y"] + (F.col("_x") - lo["_x"]) / (hi["_x"] - lo["_x"]) * (hi["_y"] - lo["_y"]))
    value = F.coalesce(inside, lo["_y"], hi["_y"]) if clamp else inside
    return both.where("_p IS NOT NULL").select(*keys, "_p.*", value.alias(y))


def interval_mean(samples: DataFrame, targets: DataFrame, x: str, y: str, at: str, length: float, by: Sequence[str] = ()) -> DataFrame:
    """``targets`` with the mean of samples strictly within length / 2 of ``at``; null where there is none."""
    half = length / 2
    cell = lambda c: F.floor(F.col(c) / length)
    near = targets.select(*by, at).distinct().withColumn("_cell", F.explode(F.array(*[cell(at) + i for i in (-1, 0, 1)])))
    hit = near.join(samples.withColumn("_cell", cell(x)), [*by, "_cell"]).where((F.col(x) > F.col(at) - half) & (F.col(x) < F.col(at) + half))
    return targets.join(hit.groupBy(*by, at).agg(F.avg(y).alias(y)), [*by, at], "left")


def fill_linear(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Nulls filled linearly by row position between the known rows around; ends take the nearest known value."""
    rows = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_i", F.row_number().over(rows).cast("double"))
    known = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).cast("double").alias("_v")))
    df = df.withColumn("_lo", F.last(known, True).over(rows.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last(known, True).over(Window.partitionBy(*by).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)))
    lo, hi = F.col("_lo"), F.col("_hi")
    lerp = lo["_v"] + (F.col("_i") - lo["_i"]) / (hi["_i"] - lo["_i"]) * (hi["_v"] - lo["_v"])
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(F.coalesce(lerp, lo["_v"], hi["_v"]))).drop("_i", "_lo", "_hi")


def resample(curve: DataFrame, x: str, y: str, points: int, top: float, by: Sequence[str]) -> DataFrame:
    """Each group's curve at ``points`` even places from 0 to ``top``; null outside, but the first place past each end takes the end's value."""
    step = top / (points - 1)
    ends = curve.where(F.col(y).isNotNull()).groupBy(*by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    grid = ends.select(*by, "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("gx", F.col("i") * F.lit(step))
    full = interpolate_at(curve, grid, x, y, "gx", by)
    inside = (F.col("gx") > F.col("_a") - step) & (F.col("gx") < F.col("_b") + step)
    return full.select(*by, "i", "gx", F.when(inside, F.col(y)).alias(y))


def overlapping(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], cell: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals that share a point, ends included. Each interval is dealt to the cells it covers; a pair is kept in its first common cell."""
    spread = lambda d, e, n: d.withColumn(n, F.floor(F.col(e[0]) / cell)).withColumn("_cell", F.explode(F.sequence(F.col(n), F.floor(F.col(e[1]) / cell))))
    both = spread(a, a_ends, "_ca").join(spread(b, b_ends, "_cb"), [*by, "_cell"])
    hit = (F.col(a_ends[0]) <= F.col(b_ends[1])) & (F.col(a_ends[1]) >= F.col(b_ends[0])) & (F.col("_cell") == F.greatest("_ca", "_cb"))
    return both.where(hit).drop("_cell", "_ca", "_cb")


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str) -> DataFrame:
    """The k rows nearest to one query vector, lower key among equals: a top-k of k rows per task, no global sort."""
    d = df.withColumn("distance", F.sqrt(distance2(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))))
    return d.orderBy("distance", key).limit(k)


def nearest_scaled(df: DataFrame, axes: Sequence[str], query: Sequence[float], n: int, key: str) -> DataFrame:
    """n + 1 rows nearest in coordinates scaled to 0..1 over the table."""
    ends = df.agg(*[F.min(a).alias(f"_lo{i}") for i, a in enumerate(axes)], *[F.max(a).alias(f"_hi{i}") for i, a in enumerate(axes)])
    far = sum(((F.col(a) - q) / (F.col(f"_hi{i}") - F.col(f"_lo{i}"))) ** 2 for i, (a, q) in enumerate(zip(axes, query, strict=True)))
    return df.crossJoin(F.broadcast(ends)).withColumn("distance", F.sqrt(far)).orderBy("distance", key).limit(n + 1).select(*df.columns, "distance")


def least_error(df: DataFrame, columns: Sequence[str], ranges: Sequence[tuple[float, float]], key: str) -> DataFrame:
    """The row with the least sum of ((v - middle) / half range) squared; the lowest key among equals."""
    sse = sum(((F.col(c) - (lo + hi) / 2) / ((hi - lo) / 2)) ** 2 for c, (lo, hi) in zip(columns, ranges, strict=True))
    return df.withColumn("sse", sse).orderBy(F.round("sse", 9), key).limit(1)


def lookup(df: DataFrame, names: DataFrame, on: str, columns: dict[str, object]) -> DataFrame:
    """Left join on a small table of attributes, missing ones replaced by defaults. Whether it is broadcast is left to its size."""
    return df.join(names.select(on, *columns), on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in columns.items()})


def with_ends(edges: DataFrame, vertices: DataFrame, vertex: str, ends: tuple[str, str], columns: Sequence[str]) -> DataFrame:
    """Edges with attributes of both ends, suffixed _0 and _1."""
    for i, end in enumerate(ends):
        edges = edges.join(vertices.select(F.col(vertex).alias(end), *[F.col(c).alias(f"{c}_{i}") for c in columns]), end)
    return edges
