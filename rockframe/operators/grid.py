"""Label grids in long form (z, x, label ...): neighbours, contacts, components, porosity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rockframe.operators.components import connected_components
from rockframe.operators.tables import row_numbers

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def neighbours(grid: DataFrame, axes: Sequence[str], label: str = "label", offsets: Sequence[tuple] = EIGHT) -> DataFrame:
    """(center, neighbour) for each cell and each of its neighbours; cells outside the grid are none.

    Only half of the offsets are joined, each pair is then told both ways.
    """
    half = [o for o in offsets if o > tuple(-i for i in o)]
    moved = grid.select(F.col(label).alias("center"), F.explode(F.array(*[F.struct(*[(F.col(a) + i).alias(a) for a, i in zip(axes, o, strict=True)]) for o in half])).alias("to")).select("center", "to.*")
    pairs = moved.join(grid.select(*axes, F.col(label).alias("neighbour")), list(axes)).select("center", "neighbour")
    return pairs.unionByName(pairs.select(F.col("neighbour").alias("center"), F.col("center").alias("neighbour")))


def contacts(grid: DataFrame, axes: Sequence[str], label: str = "label", ignore: Sequence[int] = (), self_count: bool = False) -> DataFrame:
    """(center, neighbour, n, percent): how often labels touch; a label and itself count half or 0, percent is of the neighbour's column."""
    n = F.when(F.col("center") != F.col("neighbour"), F.col("n")).otherwise(F.expr("n div 2") if self_count else F.lit(0))
    counts = neighbours(grid, axes, label).groupBy("center", "neighbour").agg(F.count(F.lit(1)).alias("n")).withColumn("n", n.cast("bigint"))
    kept = counts.where(~F.col("center").isin(*ignore) & ~F.col("neighbour").isin(*ignore)) if ignore else counts
    return kept.withColumn("percent", 100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("neighbour")), F.lit(0)))


def coordination(grid: DataFrame, axes: Sequence[str], label: str = "label") -> DataFrame:
    """(label, neighbours): how many different labels, other than 0 and itself, each label touches."""
    near = neighbours(grid, axes, label).where("center <> 0 AND neighbour <> 0 AND center <> neighbour")
    own = grid.where(F.col(label) != 0).select(F.col(label).alias("label")).distinct()
    return own.join(near.groupBy(F.col("center").alias("label")).agg(F.count_distinct("neighbour").alias("neighbours")), "label", "left").fillna(0, ["neighbours"])


def contact_areas(grid: DataFrame, axes: Sequence[str], areas: Sequence[float], label: str = "label") -> DataFrame:
    """(a, b, area): faces between different non-zero labels, by the area of a face across each axis; the next cell comes from one sort per axis."""
    out = None
    for axis, area in zip(axes, areas, strict=True):
        w = Window.partitionBy(*[x for x in axes if x != axis]).orderBy(axis)
        pair = grid.select(F.col(label).alias("p"), F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(label).over(w)).alias("q")).where("p <> 0 AND q <> 0 AND p <> q")
        own = pair.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(float(area)).alias("s"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("a", "b").agg(F.sum("s").alias("area"))


def islands(grid: DataFrame, axes: Sequence[str], label: str = "label", same: bool = True) -> DataFrame:
    """Non-zero cells with the component they belong to, over shared faces (of cells of the same label, if ``same``).

    The component's id is the least of its cells' ids (ids count cells in the order of the axes).
    """
    cells = grid.where(F.col(label) != 0).withColumn("cell", F.xxhash64(*axes))
    edges = None
    for axis in axes:
        w = Window.partitionBy(*[x for x in axes if x != axis]).orderBy(axis)
        meets = F.lead(axis).over(w) == F.col(axis) + 1
        if same:
            meets = meets & (F.lead(label).over(w) == F.col(label))
        own = cells.select(F.col("cell").alias("src"), F.when(meets, F.lead("cell").over(w)).alias("dst")).where("dst IS NOT NULL")
        edges = own if edges is None else edges.unionByName(own)
    comps = connected_components(edges).withColumnRenamed("id", "cell")
    return cells.join(comps, "cell", "left").withColumn("component", F.coalesce("component", "cell"))


def spanning(cells: DataFrame, axis: str, low: int, high: int, component: str = "component") -> DataFrame:
    """Cells of components that reach both faces of an axis."""
    faces = cells.where(F.col(axis) == low).select(component).intersect(cells.where(F.col(axis) == high).select(component))
    return cells.join(faces, component, "left_semi")


def sequential(grid: DataFrame, label: str = "label", by_size: bool = False) -> DataFrame:
    """Labels renumbered 1, 2 ... without gaps, by value or by falling count; 0 stays. Only distinct labels are ranked."""
    counts = grid.where(F.col(label) != 0).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), F.asc(label)] if by_size else [F.asc(label)]
    codes = row_numbers(counts, order, "new_label").drop("_n")
    return grid.join(codes, label, "left").fillna(0, ["new_label"])


def porosity_limits(grid: DataFrame, value: str, label: str, macro: int, solid: int) -> DataFrame:
    """One row (low, high): the most frequent values of the pore and of the solid label, the least of equals."""
    counts = grid.where(F.col(label).isin(macro, solid)).groupBy(label, value).agg(F.count(F.lit(1)).alias("n"))
    mode = lambda k: F.max_by(F.when(F.col(label) == k, F.col(value)), F.when(F.col(label) == k, F.struct("n", -F.col(value))))
    return counts.agg(mode(macro).alias("low"), mode(solid).alias("high"))


def row_proportions(grid: DataFrame, row: str, label: str, labels: Sequence[int], null_label: int) -> DataFrame:
    """Per row: share of each label among cells not of the null label; the null label's share has the same divisor; no valid cell gives 0."""
    valid = F.count_if(F.col(label) != null_label)
    return grid.groupBy(row).agg(*[F.coalesce(F.count_if(F.col(label) == k) / F.nullif(valid, F.lit(0)), F.lit(0.0)).alias(f"label_{k}") for k in labels])


def box(cells: DataFrame, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by).agg(*[F.min(a).alias(f"{a}_min") for a in axes], *[F.max(a).alias(f"{a}_max") for a in axes])


def variogram(points: DataFrame, axes: Sequence[str], value: str, key: str, lag: float, lags: int, direction: Sequence[float] | None = None, tolerance: float = 22.5) -> DataFrame:
    """(bin, gamma, pairs): half the mean squared difference of pairs by distance, up to lag * lags.

    Points meet through cells as wide as the largest distance, so far pairs are
    never formed. With a ``direction`` only pairs count whose line lies within
    ``tolerance`` degrees of it, either way.
    """
    reach = lag * lags
    cell = [F.floor(F.col(a) / reach).alias(f"_c{i}") for i, a in enumerate(axes)]
    here = points.select(*axes, value, key, *cell)
    around = here
    for i in range(len(axes)):
        around = around.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + d for d in (-1, 0, 1)])))
    a, b = around.alias("a"), here.alias("b")
    same = [F.col(f"a._c{i}") == F.col(f"b._c{i}") for i in range(len(axes))]
    on = same[0]
    for s in same[1:]:
        on = on & s
    d = F.sqrt(sum((F.col(f"a.{x}") - F.col(f"b.{x}")) ** 2 for x in axes))
    met = a.join(b, on & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    if direction:
        size = math.sqrt(sum(c * c for c in direction))
        along = sum((F.col(f"a.{x}") - F.col(f"b.{x}")) * (c / size) for x, c in zip(axes, direction, strict=True))
        met = met.where(F.abs(along) >= d * math.cos(math.radians(tolerance)))
    pairs = met.select(d.alias("d"), ((F.col(f"a.{value}") - F.col(f"b.{value}")) ** 2).alias("q"))
    inside = pairs.where((F.col("d") > 0) & (F.col("d") <= reach))
    return inside.groupBy((F.ceil(F.col("d") / lag) - 1).cast("int").alias("bin")).agg((F.avg("q") / 2).alias("gamma"), F.count(F.lit(1)).alias("pairs"))
