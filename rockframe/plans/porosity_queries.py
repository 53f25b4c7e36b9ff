"""Porosity, permeability and further label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.operators import grid as G
from rockframe.operators import joins as J
from rockframe.operators import porosity as P
from rockframe.plans.registry import DAY, GRID, day, grid, query, r4

_PICTURE = "picture AS (SELECT CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey % 64 AS INTEGER) AS x, CAST(min(l_orderkey) % 6 AS INTEGER) AS label, avg(l_quantity) AS v, avg(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2)"


def _picture(read):
    return read("lineitem").groupBy((F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") % 64).cast("int").alias("x")).agg((F.min("l_orderkey") % 6).cast("int").alias("label"), F.avg("l_quantity").alias("v"), F.avg("l_extendedprice").alias("w"))


@query(f"""WITH {_PICTURE}, s AS (SELECT least(greatest((v - label * 10) / 30.0, 0), 1) AS p FROM picture)
SELECT count(*) AS cells, count(*) FILTER (p = 1) AS macro, count(*) FILTER (p = 0) AS solid, count(*) FILTER (p > 0 AND p < 1) AS micro, round(avg(p), 6) AS porosity FROM s""")
def q90_saturated_porosity(read):
    p = _picture(read).select(P.saturated_porosity(F.col("label") * 10, F.col("v"), 0.0, 30.0).alias("p"))
    return P.porosity_counts(p, "p").select("cells", "macro", "solid", "micro", F.round("porosity", 6).alias("porosity"))


@query(f"""WITH {_PICTURE}, m AS (SELECT label, CASE WHEN x % 8 = 0 THEN 0.0 WHEN label = 1 THEN 1.0 WHEN label >= 5 THEN 0.0 WHEN label = 0 THEN 0.0 ELSE least(greatest((w / 1000 - 20 - v + 5) / (60 - 20 - 15 + 5), 0), 1) END AS phi FROM picture)
SELECT label, round(avg(phi), 6) AS phi, count(*) AS n FROM m GROUP BY 1""")
def q91_mixed_porosity(read):
    phi = P.mixed_porosity(F.col("v"), F.col("w") / 1000, F.col("label"), F.col("x") % 8, 1, 5, {"cw": 20, "cd": 5, "pw": 60, "pd": 15})
    return _picture(read).groupBy("label").agg(F.round(F.avg(phi), 6).alias("phi"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRID}, p AS (SELECT z, avg(v) / 50 AS phi, coalesce(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label <> 0), 0), 0) AS a, coalesce(count(*) FILTER (label = 2) / nullif(count(*) FILTER (label <> 0), 0), 0) AS b FROM grid GROUP BY 1)
SELECT z, round(100.0 * a + 7.0 * b * power(phi, 2.5), 4) AS permeability FROM p""")
def q92_permeability(read):
    g = grid(read)
    shares = G.row_proportions(g, "z", "label", [1, 2], 0).join(g.groupBy("z").agg((F.avg("v") / 50).alias("phi")), "z")
    return P.permeability_model(shares, "phi", "label_1", 100.0, {"label_2": (7.0, 2.5)}).select("z", *r4("permeability"))


@query(f"""WITH s AS (SELECT {DAY('l_shipdate')} AS d, l_quantity AS v FROM lineitem), i AS (SELECT DISTINCT {DAY('o_orderdate')} AS a, {DAY('o_orderdate')} + 10 AS b FROM orders)
SELECT a, b, round(avg(v) * 10, 4) AS product FROM i JOIN s ON d BETWEEN a AND b GROUP BY 1, 2""")
def q93_interval_products(read):
    s = read("lineitem").select(day("l_shipdate").alias("d"), F.col("l_quantity").alias("v"))
    i = read("orders").select(day("o_orderdate").alias("a"), (day("o_orderdate") + 10).alias("b")).distinct()
    return P.interval_products(s, i, "d", "v", ("a", "b"), 16.0).select("a", "b", *r4("product"))


@query(f"""WITH {_PICTURE}, m AS (SELECT row_number() OVER w AS i, avg(v) OVER (PARTITION BY y ORDER BY x ROWS 1 PRECEDING) AS a, avg(v) OVER (PARTITION BY y ORDER BY x ROWS 3 PRECEDING) AS b, avg(v) OVER (PARTITION BY y ORDER BY x ROWS 7 PRECEDING) AS c FROM picture WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT unnest([2, 4, 8]) AS size, round(unnest([stddev_pop(CASE WHEN i >= 2 THEN a END), stddev_pop(CASE WHEN i >= 4 THEN b END), stddev_pop(CASE WHEN i >= 8 THEN c END)]), 4) AS deviation FROM m""")
def q94_window_deviation(read):
    return P.window_deviation(_picture(read), "x", ["y"], "v", [2, 4, 8]).select("size", *r4("deviation"))


@query(f"""WITH {_PICTURE}, p AS (SELECT k AS lag, power(b.v - a.v, 2) AS q FROM picture a CROSS JOIN (SELECT unnest([1, 2, 5]) AS k) JOIN picture b ON b.y = a.y AND b.x = a.x + k) SELECT lag, round(avg(q) / 2, 4) AS gamma, count(*) AS pairs FROM p GROUP BY 1""")
def q95_axis_variogram(read):
    return P.axis_variogram(_picture(read), "x", ["y"], "v", [1, 2, 5]).select("lag", *r4("gamma"), "pairs")


@query(f"WITH {_PICTURE}, e AS (SELECT min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM picture) SELECT label, bool_or(y = a) AS y_min, bool_or(y = b) AS y_max, bool_or(x = c) AS x_min, bool_or(x = d) AS x_max FROM picture, e WHERE label <> 0 GROUP BY 1")
def q96_face_flags(read):
    return P.face_flags(_picture(read), ["y", "x"])


@query(f"WITH {_PICTURE} SELECT CAST(floor(sqrt(power(y - 20, 2) + power(x - 30, 2)) + 0.5) AS BIGINT) AS ring, round(median(v), 4) AS median, count(v) AS n FROM picture GROUP BY 1")
def q97_radial_median(read):
    return P.radial_median(_picture(read), (20.0, 30.0), "v").select("ring", *r4("median"), "n")


@query(f"""WITH {_PICTURE}, c AS (SELECT * FROM picture WHERE label <> 0), w AS (SELECT y - dy AS wy, x - dx AS wx, y, x, label FROM c CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx)),
m AS (SELECT wy, wx FROM w GROUP BY 1, 2 HAVING count(DISTINCT label) > 1) SELECT DISTINCT y, x, label FROM w JOIN m USING (wy, wx)""")
def q98_label_boundaries(read):
    return P.label_boundaries(_picture(read)).select("y", "x", "label")


@query(f"""WITH {_PICTURE}, s AS (SELECT y + 1 AS y, x + 1 AS x FROM picture WHERE label IN (1, 2, 3)), w AS (SELECT wy, wx, sum(b) AS code FROM (SELECT y AS wy, x AS wx, 1 AS b FROM s UNION ALL SELECT y, x - 1, 2 FROM s UNION ALL SELECT y - 1, x, 4 FROM s UNION ALL SELECT y - 1, x - 1, 8 FROM s) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM s) * 1.0 AS area, (SELECT 4 * count(*) FROM s) - 2.0 * ((SELECT count(*) FROM s a JOIN s b ON a.y = b.y AND a.x = b.x + 1) + (SELECT count(*) FROM s a JOIN s b ON a.x = b.x AND a.y = b.y + 1)) AS perimeter,
(SELECT (count(*) FILTER (bit_count(CAST(code AS BIGINT)) = 1) - count(*) FILTER (bit_count(CAST(code AS BIGINT)) = 3) + 2 * count(*) FILTER (code IN (6, 9))) / 4 FROM w) AS euler4""")
def q99_minkowski(read):
    return P.minkowski_2d(P.window_codes(_picture(read), F.col("label").isin(1, 2, 3)))


@query("WITH r AS (SELECT round(l_discount, 3) AS l_discount, round(l_tax, 3) AS l_tax FROM lineitem) SELECT l_discount, l_tax, count(*) AS n FROM r GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1")
def q100_modal_row(read):
    return P.modal_row(read("lineitem"), ["l_discount", "l_tax"])


@query("""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_custkey) AS c, max(o_custkey) AS d FROM orders), s AS (SELECT o_orderkey, sqrt(power((o_totalprice - 100000) / (b - a), 2) + power((o_custkey - 50.0) / (d - c), 2)) AS distance FROM orders, e)
SELECT o_orderkey, round(distance, 6) AS distance FROM s ORDER BY s.distance, o_orderkey LIMIT 6""")
def q101_nearest_scaled(read):
    return J.nearest_scaled(read("orders"), ["o_totalprice", "o_custkey"], [100000.0, 50.0], 5, "o_orderkey").select("o_orderkey", F.round("distance", 6).alias("distance"))


@query(f"WITH {_PICTURE} SELECT y // 2 AS y, x // 2 AS x, round(CAST(sum(CASE WHEN label IN (1, 2) AND y BETWEEN 3 AND 41 THEN v ELSE -1.0 END) AS DOUBLE), 4) AS v FROM picture WHERE x BETWEEN 4 AND 50 GROUP BY 1, 2")
def q102_crop_mask_resample(read):
    part = P.crop(_picture(read), {"x": (5, 49)}, pad=1)
    masked = P.mask(part, "v", F.col("label").isin(1, 2) & F.col("y").between(3, 41), -1.0)
    return masked.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.round(F.sum("v"), 4).alias("v"))
