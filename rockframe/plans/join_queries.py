"""Joins of every kind, set operations and depth windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.operators import joins as J
from rockframe.operators import tables as T
from rockframe.operators import windows as W
from rockframe.plans.registry import DAY, GRID, MONTH, WELL, day, grid, month, query, r4, well


@query("""SELECT o_orderkey, o_custkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_custkey % 25 = c_nationkey""")
def q25_equi_join(read):
    o, c = read("orders"), read("customer")
    return o.join(c, (o.o_custkey == c.c_custkey) & (o.o_custkey % 25 == c.c_nationkey)).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice")


@query(f"""WITH a AS (SELECT o_orderkey AS k, {DAY('o_orderdate')} AS n_depth, o_orderpriority AS descr FROM orders), b AS (SELECT l_orderkey AS k, {DAY('l_shipdate')} AS depth, CAST(l_quantity AS DOUBLE) AS diam FROM lineitem)
SELECT coalesce(a.k, b.k) AS k, coalesce(depth, 0) AS depth, coalesce(n_depth, 0) AS n_depth, coalesce(descr, '') AS descr, coalesce(diam, 0) AS diam FROM a FULL JOIN b ON a.k = b.k AND b.depth BETWEEN a.n_depth - 15 AND a.n_depth + 15""")
def q26_full_band_join(read):
    a = read("orders").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("n_depth"), F.col("o_orderpriority").alias("descr"))
    b = read("lineitem").select(F.col("l_orderkey").alias("k"), day("l_shipdate").alias("depth"), F.col("l_quantity").cast("double").alias("diam"))
    return J.band_join(a, b, "n_depth", "depth", 15, ["k"], "full").fillna(0, ["depth", "n_depth", "diam"]).fillna("", ["descr"]).select("k", "depth", "n_depth", "descr", "diam")


@query(f"WITH {GRID}, s AS (SELECT s_suppkey AS label, s_nationkey + 1 AS new_label FROM supplier WHERE s_suppkey < 4) SELECT z, x, coalesce(new_label, 0) AS new_label FROM grid LEFT JOIN s USING (label)")
def q27_relabel_grid(read):
    names = read("supplier").where("s_suppkey < 4").select(F.col("s_suppkey").alias("label"), (F.col("s_nationkey") + 1).alias("new_label"))
    return J.lookup(grid(read), names, "label", {"new_label": 0}).select("z", "x", "new_label")


@query(f"""WITH {WELL}, m AS (SELECT user_id, event_id, depth, event_id % 360 AS azimuth FROM well),
g AS (SELECT a.user_id, a.event_id, list_sort(list(b.event_id)) AS g FROM m a JOIN m b ON a.user_id = b.user_id AND abs(a.depth - b.depth) <= 3600 GROUP BY 1, 2),
t AS (SELECT g.user_id, g, m.event_id, azimuth FROM g JOIN m USING (user_id, event_id) WHERE len(g) = 2), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n, row_number() OVER (PARTITION BY user_id, g ORDER BY abs(azimuth - 180), event_id) AS r FROM t)
SELECT user_id, event_id, azimuth FROM n WHERE n = 2 AND r = 1""")
def q28_duplicate_marks(read):
    marks = well(read).select("user_id", "event_id", "depth", (F.col("event_id") % 360).alias("azimuth"))
    return J.duplicate_marks(marks, "depth", "event_id", "azimuth", 3600.0, ["user_id"]).select("user_id", "event_id", "azimuth")


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT l_suppkey, l_partkey, round(s_acctbal, 4) AS s_acctbal, round(p_retailprice, 4) AS p_retailprice FROM e JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")
def q29_edge_ends(read):
    e = read("lineitem").select("l_suppkey", "l_partkey").distinct()
    s = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    p = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return e.join(s, "l_suppkey").join(p, "l_partkey").select("l_suppkey", "l_partkey", *r4("s_acctbal", "p_retailprice"))


@query(f"""WITH {WELL}, c AS (SELECT user_id, depth, avg(value) AS v FROM well WHERE event_id % 4 <> 0 GROUP BY 1, 2), p AS (SELECT user_id, event_id, depth AS pos FROM well WHERE event_id % 4 = 0 AND user_id IN (SELECT user_id FROM c)),
n AS (SELECT p.*, a.depth AS x0, a.v AS y0, b.depth AS x1, b.v AS y1 FROM p ASOF LEFT JOIN c a ON p.user_id = a.user_id AND p.pos >= a.depth ASOF LEFT JOIN c b ON p.user_id = b.user_id AND p.pos <= b.depth)
SELECT user_id, event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x0 = x1 THEN y0 ELSE y0 + (pos - x0) / (x1 - x0) * (y1 - y0) END, 4) AS value FROM n""")
def q30_interpolate(read):
    w = well(read)
    curve, points = w.where("event_id % 4 <> 0"), w.where("event_id % 4 = 0").select("user_id", F.col("depth").alias("pos"), "event_id")
    return J.interpolate_at(curve, points, "depth", "value", "pos", ["user_id"]).where("value IS NOT NULL").select("user_id", "event_id", *r4("value"))


@query(f"""WITH {WELL}, t AS (SELECT u AS user_id, d AS pos FROM (SELECT DISTINCT user_id AS u FROM well) CROSS JOIN (SELECT unnest(range((SELECT CAST(floor((max(depth) - min(depth)) / 43200) AS BIGINT) + 1 FROM well))) * 43200.0 + (SELECT min(depth) FROM well) AS d)),
m AS (SELECT t.user_id, t.pos, avg(value) AS v FROM t LEFT JOIN well w ON w.user_id = t.user_id AND w.depth > t.pos - 21600 AND w.depth < t.pos + 21600 GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM m), k AS (SELECT * FROM i WHERE v IS NOT NULL),
n AS (SELECT i.user_id, i.pos, i.i, i.v, a.i AS i0, a.v AS v0, b.i AS i1, b.v AS v1 FROM i ASOF LEFT JOIN k a ON i.user_id = a.user_id AND i.i >= a.i ASOF LEFT JOIN k b ON i.user_id = b.user_id AND i.i <= b.i)
SELECT user_id, round(pos, 2) AS pos, round(CASE WHEN v IS NOT NULL THEN v WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (i - i0) / (i1 - i0) * (v1 - v0) END + 1e-7, 4) AS value FROM n""")
def q31_interval_mean_and_fill(read):
    w = well(read).select("user_id", "depth", "value")
    low = well(read).agg(F.min("depth").alias("lo"), F.floor((F.max("depth") - F.min("depth")) / 43200).cast("int").alias("last"))
    grid_ = w.select("user_id").distinct().crossJoin(F.broadcast(low)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last")))).select("user_id", (F.col("i") * 43200.0 + F.col("lo")).alias("pos"))
    means = J.interval_mean(w, grid_, "depth", "value", "pos", 43200.0, ["user_id"])
    return J.fill_linear(means, "value", "pos", ["user_id"]).select("user_id", F.round("pos", 2).alias("pos"), F.round(F.col("value") + 1e-7, 4).alias("value"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: power(x[1]::DOUBLE - x[2]::DOUBLE, 2)))), 4) AS distance FROM embeddings, q
ORDER BY sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: power(x[1]::DOUBLE - x[2]::DOUBLE, 2)))), vec_id LIMIT 10""")
def q32_nearest(read):
    df = read("embeddings")
    query_ = df.where("vec_id = 0").select("embedding").first()[0]
    return J.nearest(df, "embedding", query_, 10, "vec_id").select("vec_id", *r4("distance"))


@query("""WITH b AS (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7)
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM b) GROUP BY 1""")
def q33_both_faces(read):
    li = read("lineitem")
    both = li.where("l_linenumber = 1").select("l_suppkey").intersect(li.where("l_linenumber = 7").select("l_suppkey"))
    return li.join(both, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def q34_anti_join(read):
    return read("customer").join(read("orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH s AS (SELECT o_orderkey, power((o_totalprice - 150000) / 50000.0, 2) + power((o_custkey - 50) / 25.0, 2) AS sse FROM orders) SELECT o_orderkey, round(sse, 6) AS sse FROM s ORDER BY round(sse, 9), o_orderkey LIMIT 1""")
def q35_least_error(read):
    return J.least_error(read("orders"), ["o_totalprice", "o_custkey"], [(100000, 200000), (25, 75)], "o_orderkey").select("o_orderkey", F.round("sse", 6).alias("sse"))


@query(f"""WITH a AS (SELECT o_orderkey AS ka, o_custkey AS c, {DAY('o_orderdate')} AS s, {DAY('o_orderdate')} + 20 AS e FROM orders)
SELECT a.ka, b.ka AS kb FROM a JOIN a b ON a.c = b.c AND a.ka < b.ka AND a.s <= b.e AND a.e >= b.s""")
def q36_overlaps(read):
    a = read("orders").select(F.col("o_orderkey").alias("ka"), F.col("o_custkey").alias("c"), day("o_orderdate").alias("s"), (day("o_orderdate") + 20).alias("e"))
    b = a.select(F.col("ka").alias("kb"), "c", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return J.overlapping(a, b, ("s", "e"), ("s2", "e2"), 30, ["c"]).where("ka < kb").select("ka", "kb")


@query("""SELECT DISTINCT nationkey, balance FROM (SELECT c_nationkey AS nationkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS balance FROM customer UNION ALL SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT) FROM supplier UNION ALL SELECT n_nationkey, NULL FROM nation)""")
def q37_distinct_union(read):
    cut = lambda t, p: read(t).select(F.col(f"{p}_nationkey").alias("nationkey"), F.floor(F.col(f"{p}_acctbal") / 1000).alias("balance"))
    return T.distinct_union(cut("customer", "c"), cut("supplier", "s"), read("nation").select(F.col("n_nationkey").alias("nationkey")))


@query("""SELECT (a * 5 + b) * 3 + c AS id, round(1.0 + a * 3.0, 6) AS width, round(power(10.0, b - 2.0), 6) AS radius, CASE WHEN c = 2 THEN 180.0 ELSE 100.0 + 50.0 * c END AS angle
FROM (SELECT unnest(range(4)) AS a) CROSS JOIN (SELECT unnest(range(5)) AS b) CROSS JOIN (SELECT unnest(range(3)) AS c)""")
def q38_parameter_grid(read):
    spark = read("region").sparkSession
    axes = {"width": T.spaced(1, 10, 4), "radius": T.spaced(0.01, 100, 5, log=True), "angle": T.spaced(100, 200, 3)}
    return T.parameter_grid(spark, axes, {"angle": (0.0, 180.0)}).select("id", F.round("width", 6).alias("width"), F.round("radius", 6).alias("radius"), "angle")


@query(f"""WITH {WELL}, f AS (SELECT user_id, min(depth) AS d0 FROM well GROUP BY 1)
SELECT user_id, round(d0 + (floor((depth - d0) / 86400) + 1) * 86400, 2) AS window_end, count(*) AS n, round(avg(value), 4) AS mean FROM well JOIN f USING (user_id) GROUP BY 1, 2""")
def q41_tumbling(read):
    return W.tumbling(well(read), "depth", 86400.0, ["user_id"], F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("user_id", F.round("window_end", 2).alias("window_end"), "n", *r4("mean"))


@query("""WITH s AS (SELECT p_brand, count(p_size) AS n, stddev_samp(p_size) AS s FROM part GROUP BY 1), g AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS i)
SELECT p_brand, i, round(sum(exp(-power((1 + i * 49.0 / 199 - p_size) / (0.3 * s), 2) / 2)) / (max(n) * 0.3 * max(s) * sqrt(2 * pi())), 6) AS density FROM part JOIN s USING (p_brand) CROSS JOIN g GROUP BY 1, 2""")
def q42_kde(read):
    return W.kde(read("part"), "p_size", ["p_brand"], 200, 1.0, 50.0, 0.3).select("p_brand", "i", F.round("density", 6).alias("density"))


@query(f"""WITH {WELL}, u AS (SELECT * FROM well), m AS (SELECT user_id, avg(value) OVER (PARTITION BY user_id ORDER BY depth, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY depth, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS b, avg(value) OVER (PARTITION BY user_id ORDER BY depth, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS c FROM u),
s AS (SELECT user_id, unnest([2 * ln(2), 2 * ln(4), 2 * ln(8)]) AS x, unnest([ln(stddev_pop(a) + 1e-9), ln(stddev_pop(b) + 1e-9), ln(stddev_pop(c) + 1e-9)]) AS y FROM m GROUP BY user_id)
SELECT user_id, round(-regr_slope(y, x), 4) AS index FROM s GROUP BY 1""")
def q43_heterogeneity(read):
    rows = well(read).select("user_id", "value", F.struct("depth", "event_id").alias("at"))
    return W.heterogeneity(rows, "value", "at", ["user_id"], [2, 4, 8]).select("user_id", *r4("index"))


@query(f"""WITH {WELL}, n AS (SELECT *, CASE WHEN depth - lag(depth) OVER (PARTITION BY user_id ORDER BY depth) <= 7200 THEN 0 ELSE 1 END AS f FROM well), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY depth RANGE UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def q44_sessions(read):
    return W.sessions(well(read), "depth", 7200.0, ["user_id"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", "session", "n", *r4("total"))


@query(f"""WITH {WELL}, i AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY depth) AS i FROM well), k AS (SELECT * FROM i WHERE v IS NOT NULL),
n AS (SELECT i.user_id, i.event_id, i.i, i.v, a.i AS i0, a.v AS v0, b.i AS i1, b.v AS v1 FROM i ASOF LEFT JOIN k a ON i.user_id = a.user_id AND i.i >= a.i ASOF LEFT JOIN k b ON i.user_id = b.user_id AND i.i <= b.i)
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (i - i0) / (i1 - i0) * (v1 - v0) END, 4) AS value FROM n""")
def q45_fill_linear(read):
    gaps = well(read).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return J.fill_linear(gaps, "value", "depth", ["user_id"]).select("user_id", "event_id", *r4("value"))


@query("""WITH c AS (SELECT p_brand AS g, p_size / 100.0 AS x, avg(p_retailprice) AS y FROM part WHERE p_size BETWEEN 5 AND 40 AND (p_partkey % 3 <> 0) GROUP BY 1, 2), e AS (SELECT g, min(x) AS a, max(x) AS b FROM c GROUP BY 1), k AS (SELECT g, a, b, i, i * 2.5e-3 AS gx FROM e CROSS JOIN (SELECT CAST(unnest(range(201)) AS INTEGER) AS i)),
n AS (SELECT k.*, l.x AS x0, l.y AS y0, r.x AS x1, r.y AS y1 FROM k ASOF LEFT JOIN c l ON k.g = l.g AND k.gx >= l.x ASOF LEFT JOIN c r ON k.g = r.g AND k.gx <= r.x)
SELECT g AS p_brand, i, CASE WHEN gx > a - 2.5e-3 AND gx < b + 2.5e-3 THEN round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x0 = x1 THEN y0 ELSE y0 + (gx - x0) / (x1 - x0) * (y1 - y0) END + 1e-7, 2) END AS y FROM n""")
def q46_resample(read):
    c = read("part").where("p_size BETWEEN 5 AND 40 AND p_partkey % 3 <> 0").select("p_brand", (F.col("p_size") / 100.0).alias("x"), F.col("p_retailprice").alias("y"))
    return J.resample(c, "x", "y", 201, 0.5, ["p_brand"]).select("p_brand", "i", F.round(F.col("y") + 1e-7, 2).alias("y"))


_LAGS = "PARTITION BY user_id ORDER BY depth"


@query(f"""WITH {WELL}, g AS (SELECT user_id, event_id, depth, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM well), n AS (SELECT *, lag(v) OVER ({_LAGS}) AS a, lead(v) OVER ({_LAGS}) AS b FROM g)
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN (coalesce(0.25 * a, 0) + 0.5 * v + coalesce(0.25 * b, 0)) / (0.5 + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) END, 4) AS smoothed FROM n""")
def q47_smooth(read):
    gaps = well(read).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return W.smooth(gaps, "value", "depth", ["user_id"], [0.25, 0.5, 0.25]).select("user_id", "event_id", *r4("smoothed"))


@query(f"""WITH {WELL} SELECT user_id, event_id, round(avg(value * value) OVER w - power(avg(value) OVER w, 2) + 1e-7, 4) AS variance FROM well WINDOW w AS (PARTITION BY user_id ORDER BY depth ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q48_moving_variance(read):
    return W.moving_variance(well(read), "value", "depth", ["user_id"], 2).select("user_id", "event_id", F.round(F.col("variance") + 1e-7, 4).alias("variance"))


@query(f"WITH {GRID} SELECT CAST(floor(z / 16) AS BIGINT) AS z, CAST(floor(x / 2) AS BIGINT) AS x, round(avg(v), 4) AS v FROM grid GROUP BY 1, 2")
def q49_block_mean(read):
    return W.block_mean(grid(read), "v", {"z": 16, "x": 2}).select("z", "x", *r4("v"))


@query(f"""WITH {GRID}, s AS (SELECT z, v, row_number() OVER (PARTITION BY z ORDER BY v, x) AS place FROM grid) SELECT z, place, round(v, 4) AS v, round(coalesce(sum(v) OVER (PARTITION BY z ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start FROM s""")
def q50_sorted_rows_and_running_sum(read):
    s = W.sorted_rows(grid(read), "z", "v", "x")
    return W.running_start(s, "v", "place", ["z"]).select("z", "place", *r4("v", "start"))


@query(f"""WITH m AS (SELECT o_orderpriority AS g, {MONTH('o_orderdate')} AS m, avg(o_totalprice) AS a, count(*) * 1.0 AS b FROM orders GROUP BY 1, 2), n AS (SELECT g, a * b AS c0, a * lead(b) OVER (PARTITION BY g ORDER BY m) AS c1, a * lag(b, 2) OVER (PARTITION BY g ORDER BY m) AS c2 FROM m)
SELECT g, unnest([0, 1, -2]) AS lag, round(unnest([sum(c0), sum(c1), sum(c2)]), 2) AS r FROM n GROUP BY g""")
def q71_cross_correlation(read):
    m = read("orders").groupBy(F.col("o_orderpriority").alias("g"), month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return W.cross_correlation(m, "m", "a", "b", ["g"], [0, 1, -2]).select("g", "lag", F.round("r", 2).alias("r"))


@query(f"""WITH g AS (SELECT l_orderkey AS z, l_linenumber - 1 AS x, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT z, x, v, CASE WHEN z % 3 = 0 THEN 0.0 ELSE z % 5 + 0.5 END AS k FROM g),
t AS (SELECT z, (x + floor(k)) % 7 AS x, v * (1 - (k - floor(k))) AS v FROM s UNION ALL SELECT z, (x + floor(k) + 1) % 7, v * (k - floor(k)) FROM s) SELECT z, CAST(x AS INTEGER) AS x, round(sum(v), 4) AS v FROM t GROUP BY 1, 2""")
def q72_circular_shift(read):
    g = read("lineitem").groupBy(F.col("l_orderkey").alias("z"), (F.col("l_linenumber") - 1).alias("x")).agg(F.avg("l_quantity").alias("v"))
    g = g.withColumn("k", F.when(F.col("z") % 3 != 0, F.col("z") % 5 + 0.5))
    return W.circular_shift(g, "z", "x", "v", "k", 7).select("z", "x", *r4("v"))


@query("""WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 5 UNION ALL SELECT NULL), c AS (SELECT k FROM a UNION ALL SELECT NULL)
SELECT k FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM c.k) UNION ALL SELECT k FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE b.k IS NOT DISTINCT FROM c.k)""")
def q73_unmatched_both_sides(read):
    keys = read("nation").select(F.col("n_nationkey").alias("k"))
    none = keys.limit(1).select(F.lit(None).cast("int").alias("k"))
    return T.unmatched(keys.where("k < 20").union(none), keys.where("k > 5").union(none), ["k"])


@query("SELECT l_returnflag, l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY price DESC, l_orderkey * 10 + l_linenumber) <= 5")
def q74_top_k(read):
    rows = read("lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    ranked = T.top_k(rows.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), 5, "price", ["l_returnflag"], "k")
    return ranked.select("l_returnflag", "l_orderkey", "l_linenumber", "price")


