"""Masks, null-aware statistics, depth matching, names, sub-scale radii, directional variograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import grid as G
from rockframe.operators import labels as L
from rockframe.operators import subscale as S
from rockframe.plans.registry import DAY, GRID, WELL, day, grid, query, r4, well


@query(f"WITH {GRID} SELECT z, x, CASE WHEN label IN (1, 3) THEN 7 ELSE 0 END AS masked, CASE WHEN v < 20 THEN 0 ELSE round(v, 4) END AS above, label IN (2, 4) AS either, label <> 0 AS any_label FROM grid")
def q110_masks(read):
    label = F.col("label")
    return grid(read).select("z", "x", L.mask_of(label, [1, 3], 7).alias("masked"), F.round(L.zero_below(F.col("v"), 20), 4).alias("above"), L.merged(label, [2, 4]).alias("either"), L.merged(label).alias("any_label"))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem WHERE l_quantity NOT IN (1, 50) GROUP BY 1")
def q111_valid_stats(read):
    return L.valid_stats(read("lineitem"), "l_quantity", [1, 50], ["l_returnflag"]).select("l_returnflag", "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT p_partkey, p_name, s_nationkey AS \"limit\" FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def q112_exclusion_list(read):
    out = read("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    limits = read("supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_nationkey").alias("limit"))
    return L.without_listed(read("part").select("p_partkey", "p_name"), out, "p_partkey", limits)


@query("""WITH e AS (SELECT unnest(range(5)) AS bin, unnest([-1.5, 6.5, 15.0, 25.0, 35.0]) AS low, unnest([6.5, 15.0, 25.0, 35.0, 44.0]) AS high)
SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, (SELECT count(*) FROM lineitem WHERE l_quantity >= low AND (l_quantity < high OR (bin = 4 AND l_quantity = high))) AS n FROM e""")
def q113_centre_histogram(read):
    return L.centre_histogram(read("lineitem"), "l_quantity", [2.5, 10.5, None, 19.5, 30.5, 39.5, 30.5, float("nan")])


@query("SELECT o_orderstatus, o_orderpriority, string_agg(o_orderkey || ':' || o_custkey, ',' ORDER BY o_orderkey, o_custkey) AS sets FROM orders GROUP BY 1, 2")
def q114_parameter_sets(read):
    sets = L.parameter_sets(read("orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return sets.withColumn("sets", F.array_join(F.transform("sets", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_custkey"])), ","))


@query(" UNION ALL ".join(f"SELECT p_brand, '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM part GROUP BY 1" for c in ("p_size", "p_retailprice")))
def q115_describe(read):
    out = L.describe(read("part"), ["p_size", "p_retailprice"], ["p_brand"])
    return out.select("p_brand", "column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("SELECT round(quantile_cont(o_totalprice, 0.02), 4) AS low, round(quantile_cont(o_totalprice, 0.98), 4) AS high FROM orders")
def q116_zoom_limits(read):
    return L.zoom_limits(read("orders"), "o_totalprice", 2, 98).select(*r4("low", "high"))


@query(f"""WITH a AS (SELECT l_suppkey AS k, {DAY('l_shipdate')} AS d FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS k, {DAY('l_shipdate')} AS d FROM lineitem WHERE l_returnflag <> 'A'),
e AS (SELECT k, greatest(min(a.d), any_value(b0)) AS lo, least(max(a.d), any_value(b1)) AS hi FROM a JOIN (SELECT k, min(d) AS b0, max(d) AS b1 FROM b GROUP BY 1) USING (k) GROUP BY 1)
SELECT 'a' AS log, k, d FROM a JOIN e USING (k) WHERE d > lo AND d < hi UNION ALL SELECT 'b', k, d FROM b JOIN e USING (k) WHERE d > lo AND d < hi""")
def q117_shared_depths(read):
    rows = read("lineitem").select("l_returnflag", F.col("l_suppkey").alias("k"), day("l_shipdate").alias("d"))
    a, b = L.shared_depths(rows.where("l_returnflag = 'A'").drop("l_returnflag"), rows.where("l_returnflag <> 'A'").drop("l_returnflag"), "d", ["k"])
    return a.select(F.lit("a").alias("log"), "k", "d").unionByName(b.select(F.lit("b").alias("log"), "k", "d"))


@query(f"WITH {WELL} SELECT DISTINCT user_id, user_id % 3 = 0 OR (user_id % 3 = 2 AND user_id NOT IN (SELECT user_id FROM well WHERE event_id % 50 = 0)) AS same FROM well")
def q118_same_depths(read):
    a = well(read).select("user_id", "event_id", "depth")
    moved = F.col("depth") + F.when(F.col("user_id") % 3 == 1, 100.0).otherwise(1e-10)
    b = a.where((F.col("user_id") % 3 == 0) | (F.col("user_id") % 3 == 1) | (F.col("event_id") % 50 != 0)).select("user_id", moved.alias("depth"))
    return L.same_depths(a.drop("event_id"), b, "depth", ["user_id"], 1e-6)


@query("""WITH c AS (SELECT l_orderkey AS t, l_suppkey % 6 AS label, count(*) AS n FROM lineitem WHERE l_suppkey % 6 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, label) AS r FROM c), p AS (SELECT t, min(label) || '-' || max(label) AS id FROM r WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT t // 20 AS block, t, CASE WHEN count(*) OVER (PARTITION BY t // 20, id) > 1 THEN id || chr(CAST(96 + row_number() OVER (PARTITION BY t // 20, id ORDER BY t) AS INTEGER)) ELSE id END AS id FROM p""")
def q119_throat_ids(read):
    cells = read("lineitem").select(F.expr("l_orderkey div 20").alias("block"), F.col("l_orderkey").alias("t"), (F.col("l_suppkey") % 6).alias("label"))
    return L.throat_ids(cells, "t", "label", ["block"])


@query("SELECT l_linenumber * 0.5 AS radius, round(1 / (l_linenumber * 0.5), 5) AS inverse, round(ln(1 / (l_linenumber * 0.5)), 5) AS log_inverse, round(0.9 * l_linenumber / 16, 5) AS snw, round(1 - 0.9 * l_linenumber / 16, 5) AS sw, round(1 - l_linenumber / 16, 5) AS sws FROM lineitem")
def q120_porosimetry(read):
    rows = read("lineitem").select((F.col("l_linenumber") * 0.5).alias("r"), (F.col("l_linenumber") / 16.0).alias("snw"))
    return L.porosimetry(rows, "r", "snw", 0.1)


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 11 % 256 AS INTEGER) AS g, CAST(p_partkey * 13 % 256 AS INTEGER) AS b FROM part), q AS (SELECT k, r, g, b, CAST(floor(least(r * 1.25, 255)) AS INTEGER) AS r1, CAST(floor(least(g * 1.25, 255)) AS INTEGER) AS g1, CAST(floor(least(b * 1.25, 255)) AS INTEGER) AS b1 FROM p), m AS (SELECT floor(avg(r1 * 0.299 + g1 * 0.587 + b1 * 0.114) + 0.5) AS m FROM q),
x AS (SELECT k, r, g, b, m, r1, g1, b1, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM q, m)
SELECT k, CAST(floor(least(greatest(m + (r1 - m) * 1.5, 0), 255)) AS INTEGER) AS r, CAST(floor(least(greatest(m + (g1 - m) * 1.5, 0), 255)) AS INTEGER) AS g, CAST(floor(least(greatest(m + (b1 - m) * 1.5, 0), 255)) AS INTEGER) AS b,
round(coalesce(60.0 * CASE WHEN span = 0 THEN NULL WHEN hi = r THEN CASE WHEN g < b THEN (g - b) / span + 6.0 ELSE (g - b) / span END WHEN hi = g THEN (b - r) / span + 2.0 ELSE (r - g) / span + 4.0 END, 0), 4) AS hue, round(coalesce(span / nullif(hi, 0), 0), 4) AS saturation FROM x""")
def q121_picture_enhancement(read):
    k = F.col("p_partkey")
    p = read("part").select(k.alias("k"), *[(k * f % 256).cast("int").alias(c) for c, f in (("r", 7), ("g", 11), ("b", 13))])
    hue, sat, _ = C.hsv(F.col("r"), F.col("g"), F.col("b"))
    tones = p.select("k", F.round(hue, 4).alias("hue"), F.round(sat, 4).alias("saturation"))
    return L.brightness_contrast(p, ["r", "g", "b"], 25, 50).join(tones, "k")


@query("""WITH p AS (SELECT vec_id AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings), d AS (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d, abs(a.x - b.x) AS dx, power(a.v - b.v, 2) AS q FROM p a JOIN p b ON a.k < b.k)
SELECT CAST(ceil(d / 0.05) - 1 AS INTEGER) AS bin, round(avg(q) / 2, 6) AS gamma, count(*) AS pairs FROM d WHERE d > 0 AND d <= 0.05 * 6 AND dx >= d * cos(radians(30)) GROUP BY 1""")
def q122_directional_variogram(read):
    p = read("embeddings").select(F.col("vec_id").alias("k"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyv")])
    return G.variogram(p, ["x", "y"], "v", "k", 0.05, 6, (1.0, 0.0), 30.0).select("bin", F.round("gamma", 6).alias("gamma"), "pairs")


@query("""WITH s AS (SELECT p_partkey AS k, p_size / 100.0 AS phi FROM part), e AS (SELECT min(phi) AS lo, (max(phi) - min(phi)) / 99 AS w FROM s), h AS (SELECT least(CAST(floor((phi - lo) / w) AS INTEGER), 98) AS b, count(*) AS n FROM s, e GROUP BY 1),
f AS (SELECT i AS b, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(99)) AS INTEGER) AS i) LEFT JOIN h ON h.b = i), c AS (SELECT b, lo + w * b AS x, sum(n) OVER (ORDER BY b) / (SELECT count(*) FROM s) AS y FROM f, e),
u AS (SELECT k, phi, arg_max(c.y, c.b) AS y0, arg_max(c.x, c.b) AS x0, max(c.b) AS b FROM s JOIN c ON c.x <= phi GROUP BY 1, 2), v AS (SELECT k, CASE WHEN u.b = 98 THEN y0 ELSE y0 + (phi - x0) / (c.x - x0) * (c.y - y0) END AS t FROM u LEFT JOIN c ON c.b = u.b + 1),
g AS (SELECT k, CASE WHEN t < 0.2 THEN 1e4 WHEN t < 0.5 THEN 1e4 + (t - 0.2) / 0.3 * 1e4 WHEN t < 1 THEN 2e4 + (t - 0.5) / 0.5 * 6e4 ELSE 8e4 END AS pressure FROM v)
SELECT k, round(2 * 0.48 * abs(cos(radians(140))) / pressure * 1e6 + 1e-8, 4) AS radius FROM g""")
def q123_curve_radius(read):
    t = read("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("phi"))
    radius = S.curve_radius(t, "phi", [8e4, 1e4, 2e4], [0.5, 0.2, 0.3])
    return t.select("k", F.round(radius * 1e6 + 1e-8, 4).alias("radius"))


@query(f"""WITH {WELL}, i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY depth, event_id) - 1 AS i, value AS a, event_id % 7 * 1.0 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM well), w AS (SELECT user_id, unnest(range((n + 1 - 16) // 8)) AS w FROM (SELECT user_id, max(n) AS n FROM i GROUP BY 1) WHERE n >= 16), g AS (SELECT unnest([-2, 0, 3]) AS lag)
SELECT w.user_id, CAST(w AS INTEGER) AS window, lag, round(sum(p.a * q.b), 4) AS r FROM w CROSS JOIN g JOIN i q ON q.user_id = w.user_id AND q.i >= w * 8 AND q.i < w * 8 + 16 JOIN i p ON p.user_id = w.user_id AND p.i = q.i + lag AND p.i >= w * 8 AND p.i < w * 8 + 16 GROUP BY 1, 2, 3""")
def q124_windowed_correlation(read):
    rows = well(read).select("user_id", F.struct("depth", "event_id").alias("at"), F.col("value").alias("a"), (F.col("event_id") % 7 * 1.0).alias("b"))
    return L.windowed_cross_correlation(rows, "at", "a", "b", ["user_id"], 16, 8, [-2, 0, 3]).select("user_id", "window", "lag", *r4("r"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def q125_content_hash(read):
    return read("documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
