"""Pore networks as vertex and edge tables, and relative-permeability curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rockframe.functions.classify import conductivity, series
from rockframe.operators.components import connected_components
from rockframe.operators.grid import contact_areas
from rockframe.operators.joins import with_ends
from rockframe.operators.porosity import face_flags
from rockframe.operators.tables import row_numbers


def clusters(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every vertex on an edge."""
    return connected_components(edges, a, b)


def sub_network(pores: DataFrame, throats: DataFrame, keep: DataFrame, pore: str, ends: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The pores in ``keep`` renumbered from 0 by id, and the throats between them with the new numbers."""
    ids = pores.join(keep.select(pore), pore, "left_semi").select(pore).distinct()
    ids = row_numbers(ids, [pore], "new_id").withColumn("new_id", F.col("new_id") - 1)
    own = pores.join(ids, pore)
    for i, e in enumerate(ends):
        throats = throats.join(ids.select(F.col(pore).alias(e), F.col("new_id").alias(f"new_{i}")), e)
    return own, throats


def throat_conductance(throats: DataFrame, pores: DataFrame, pore: str, ends: tuple[str, str]) -> DataFrame:
    """Adds conductance: pore, throat and pore in series. Pores have radius, shape and length; throats too."""
    both = with_ends(throats, pores, pore, ends, ["radius", "shape", "length"])
    k = [conductivity(F.col(f"radius_{i}"), F.col(f"shape_{i}")) for i in (0, 1)]
    mid = conductivity(F.col("radius"), F.col("shape"))
    return both.withColumn("conductance", series((F.col("length_0"), k[0]), (F.col("length"), mid), (F.col("length_1"), k[1])))


def boundary_flow(throats: DataFrame, pores: DataFrame, pore: str, ends: tuple[str, str], viscosity: float) -> DataFrame:
    """One row (inlet, outlet, flow): flow over throats between one face pore and one inner pore, and the mean of both faces.

    Pores have pressure, inlet and outlet; throats have conductance.
    """
    both = with_ends(throats, pores, pore, ends, ["pressure", "inlet", "outlet"])
    q = F.abs(F.col("pressure_1") - F.col("pressure_0")) * F.col("conductance") / viscosity
    inner = lambda i: ~F.col(f"inlet_{i}") & ~F.col(f"outlet_{i}")
    at = lambda face: (F.col(f"{face}_0") & inner(1)) | (F.col(f"{face}_1") & inner(0))
    sums = both.agg(*[F.coalesce(F.sum(F.when(at(f), q)), F.lit(0.0)).alias(f) for f in ("inlet", "outlet")])
    return sums.withColumn("flow", (F.col("inlet") + F.col("outlet")) / 2)


def network_summary(pores: DataFrame, volume: str, phase: str, porosity: str) -> DataFrame:
    """Resolved (phase 1) volume, sub-resolution (phase 2) volume and its pore space, and their sum."""
    v = F.col(volume)
    part = lambda k, x: F.coalesce(F.sum(F.when(F.col(phase) == k, x)), F.lit(0.0))
    return pores.agg(part(1, v).alias("resolved"), part(2, v).alias("unresolved"), part(2, v * F.col(porosity)).alias("unresolved_pore"), (part(1, v) + part(2, v * F.col(porosity))).alias("pore_volume"))


def pore_shape_factors(throats: DataFrame, ends: tuple[str, str], shape: str, area: str) -> DataFrame:
    """(pore, shape): mean of the shape factors of a pore's throats, by their area."""
    both = throats.select(F.col(ends[0]).alias("pore"), shape, area).unionAll(throats.select(F.col(ends[1]).alias("pore"), shape, area))
    return both.groupBy("pore").agg((F.sum(F.col(shape) * F.col(area)) / F.sum(area)).alias("shape"))


def curve_points(curves: DataFrame, by: str, cycle: str, order: str, sw: str, krw: str, kro: str) -> DataFrame:
    """Per simulation, of its second cycle: swi, kro_swi, swr, krw_swr, and the crossing of both curves (0 where there is none).

    The crossing is at the first row after the first with kro <= krw, linear
    between it and the row before; equal saturations count as 1e-5 apart.
    """
    two = curves.where(F.col(cycle) == 2)
    w = Window.partitionBy(by).orderBy(order)
    p = lambda c: F.lag(c).over(w)
    rows = two.select(by, order, sw, krw, kro, p(sw).alias("s0"), p(krw).alias("w0"), p(kro).alias("o0"))
    ds = F.when(F.col(sw) == F.col("s0"), 1e-5).otherwise(F.col(sw) - F.col("s0"))
    slope_w, slope_o = (F.col(krw) - F.col("w0")) / ds, (F.col(kro) - F.col("o0")) / ds
    step = F.when(slope_w == slope_o, 0.0).otherwise((F.col("o0") - F.col("w0")) / (slope_w - slope_o))
    cross = F.when(F.col("s0").isNotNull() & (F.col(kro) <= F.col(krw)), F.struct(F.col(order), (F.col("s0") + step).alias("s"), (F.col("w0") + slope_w * step).alias("k")))
    rows = rows.withColumn("_x", cross)
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    return rows.groupBy(by).agg(first(sw).alias("swi"), first(kro).alias("kro_swi"), last(sw).alias("swr"), last(krw).alias("krw_swr"), F.coalesce(F.min("_x")["s"], F.lit(0.0)).alias("sw_cross"), F.coalesce(F.min("_x")["k"], F.lit(0.0)).alias("k_cross"))


def mean_curve(curves: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean over simulations at each place, leaving nulls and NaN out."""
    return curves.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v))).alias(v) for v in values])


def wettability(curves: DataFrame, by: str, cycle: str, order: str, sw: str, pc: str) -> DataFrame:
    """Per simulation: Iw, Io, amott and usbm from the capillary pressure of cycles 2 (imbibition) and 3 (drainage).

    spw is where the pressure of cycle 2 falls through 0, spo where that of
    cycle 3 rises through it (linear between rows). Iw = (spw - scw) / (1 - sor - scw)
    and Io = (spo - sor) / (1 - sor - scw), with oil saturations for spo and
    sor; amott = Iw - Io; usbm = (a2 - a1) / (a1 + a2) of the areas beyond
    either crossing. What a missing cycle or crossing leaves open is 0.
    """
    w = Window.partitionBy(by, cycle).orderBy(order)
    s, p, s0, p0 = F.col(sw), F.col(pc), F.col("_s0"), F.col("_p0")
    rows = curves.where(F.col(cycle).isin(2, 3)).withColumn("_s0", F.lag(sw).over(w)).withColumn("_p0", F.lag(pc).over(w))
    through = F.when(F.col(cycle) == 2, (p0 > 0) & (p <= 0)).otherwise((p0 < 0) & (p >= 0))
    at = F.when(through, F.struct(F.col(order).alias("i"), (s0 + p0 / (p0 - p) * (s - s0)).alias("s")))
    rows = rows.withColumn("_x", F.min(at).over(Window.partitionBy(by, cycle)))
    step = F.when(F.col(order) == F.col("_x")["i"], F.abs(p) * F.abs(s - F.col("_x")["s"]) / 2).when(F.col(order) > F.col("_x")["i"], (F.abs(p) + F.abs(p0)) / 2 * F.abs(s - s0))
    one = lambda k, c: F.max(F.when(F.col(cycle) == k, c))
    area = lambda k: F.coalesce(F.sum(F.when(F.col(cycle) == k, step)), F.lit(0.0))
    got = rows.groupBy(by).agg(
        F.min_by(F.when(F.col(cycle) == 2, s), F.when(F.col(cycle) == 2, F.col(order))).alias("scw"),
        (1 - F.max_by(F.when(F.col(cycle) == 2, s), F.when(F.col(cycle) == 2, F.col(order)))).alias("sor"),
        one(2, F.col("_x")["s"]).alias("spw"),
        (1 - one(3, F.col("_x")["s"])).alias("spo"),
        area(2).alias("a1"),
        area(3).alias("a2"),
    )
    movable = F.nullif(1 - F.col("sor") - F.col("scw"), F.lit(0.0))
    iw, io = F.coalesce((F.col("spw") - F.col("scw")) / movable, F.lit(0.0)), F.coalesce((F.col("spo") - F.col("sor")) / movable, F.lit(0.0))
    usbm = F.coalesce((F.col("a2") - F.col("a1")) / F.nullif(F.col("a1") + F.col("a2"), F.lit(0.0)), F.lit(0.0))
    return got.select(by, iw.alias("Iw"), io.alias("Io"), (iw - io).alias("amott"), usbm.alias("usbm"))


def sub_scale_conductivity(diameter, porosity, capillary_radius, shape):
    """Conductivity of an unresolved pore: that of one capillary times how many fill the pore space of its section (column expressions)."""
    count = (diameter * diameter / 4 / (4 * shape)) * porosity / (capillary_radius * capillary_radius / (4 * shape))
    return conductivity(capillary_radius, shape) * count


def correct_saturation(curves: DataFrame, sw: str, volumes: DataFrame, by: str, volume: str) -> DataFrame:
    """Curves with Sw (1 - v) + v, v being each simulation's unswept share."""
    return curves.join(volumes.select(by, volume), by).withColumn(sw, F.col(sw) * (1 - F.col(volume)) + F.col(volume)).drop(volume)


def extract_network(cells: DataFrame, spacing: tuple[float, float, float], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(pores, throats) of a label grid (z, y, x, label): each label a pore, each pair of touching labels a throat.

    pores: pore, volume, equivalent diameter, centre, and whether it touches
    each face; throats: a, b, area, diameter of the circle of that area, and
    the distance of the centres. Labels meet through one window per axis.
    """
    sz, sy, sx = spacing
    scaled = cells.withColumns({f"_{a}": F.col(a) * s for a, s in zip("zyx", spacing, strict=True)})
    volume = F.count(F.lit(1)) * F.lit(sz * sy * sx)
    pores = scaled.where(F.col(label) != 0).groupBy(F.col(label).alias("pore")).agg(volume.alias("volume"), *[F.avg(f"_{a}").alias(a) for a in "zyx"])
    pores = pores.withColumn("diameter", F.pow(6 * F.col("volume") / math.pi, F.lit(1 / 3)))
    pores = pores.join(face_flags(cells, ["z", "y", "x"], label).withColumnRenamed(label, "pore"), "pore")
    throats = with_ends(contact_areas(cells, ["z", "y", "x"], [sy * sx, sz * sx, sz * sy], label), pores, "pore", ("a", "b"), ["z", "y", "x"])
    far = F.sqrt(sum((F.col(f"{c}_0") - F.col(f"{c}_1")) ** 2 for c in "zyx"))
    return pores, throats.select("a", "b", "area", F.sqrt(4 * F.col("area") / math.pi).alias("diameter"), far.alias("length"))


def connected_network(pores: DataFrame, throats: DataFrame, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """What is connected from one face to the other: pores of components with a pore on both, and the throats between them."""
    placed = pores.join(clusters(throats, "a", "b").withColumnRenamed("id", "pore"), "pore")
    both = placed.where(F.col(low)).select("component").intersect(placed.where(F.col(high)).select("component"))
    kept = placed.join(both, "component", "left_semi").drop("component")
    ids = kept.select("pore")
    inside = throats.join(ids.withColumnRenamed("pore", "a"), "a", "left_semi").join(ids.withColumnRenamed("pore", "b"), "b", "left_semi")
    return kept, inside
