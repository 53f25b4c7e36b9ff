"""Scalar functions, null handling and table reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import aggregates as A
from rockframe.operators import porosity as P
from rockframe.operators import tables as T
from rockframe.plans.registry import WELL, query, r4, well


@query("""SELECT p_partkey, round(0.96 * abs(cos(radians(140.0))) / p_size, 6) AS radius, round(CASE WHEN p_size / 50.0 > 0.1 THEN 3.0 * power(p_size / 50.0 - 0.1, 2.5) ELSE 0 END, 6) AS timur, round(p_size * 2.0 + 1, 4) AS line,
round((p_size / 50.0) * (1 - 0.2) + 0.2, 6) AS saturation, round(1 / (1 + 0.5 * (p_size / 50.0) / (2.0 * (1.02 - p_size / 50.0))), 6) AS flow, round(p_size * (0.001 * 2.0 / (3.0 * 4.0) * 1.01325e11), 2) AS darcy,
round(pi() * p_size * p_retailprice, 4) AS ellipse, round(0.2125 * p_size + 0.7154 * (p_partkey % 256) + 0.0721 * 7, 4) AS gray FROM part""")
def q103_physics(read):
    s = F.col("p_size")
    share = s / 50.0
    return read("part").select(
        "p_partkey",
        F.round(C.capillary_radius(s), 6).alias("radius"),
        F.round(C.timur_coates(share, 3.0, 2.5, 0.1), 6).alias("timur"),
        F.round(C.line(s, 2.0, 1.0), 4).alias("line"),
        F.round(C.corrected_saturation(share, F.lit(0.2)), 6).alias("saturation"),
        F.round(C.fractional_flow(1.02 - share, share, 0.5, 2.0), 6).alias("flow"),
        F.round(C.darcy_permeability(s, 0.001, 2.0, 3.0, 4.0), 2).alias("darcy"),
        F.round(C.ellipse_area(s, F.col("p_retailprice")), 4).alias("ellipse"),
        F.round(C.gray(s, F.col("p_partkey") % 256, F.lit(7)), 4).alias("gray"),
    )


@query("""WITH a AS (SELECT p_partkey, atan2(p_size - 25.0, (p_partkey % 13) - 6.0) AS t FROM part), d AS (SELECT p_partkey, degrees(t) + CASE WHEN t < 0 THEN 180 ELSE 0 END AS d FROM a)
SELECT p_partkey, round(CASE WHEN d > 90 AND d < 270 THEN (d + 180) % 360 ELSE d END, 6) AS angle, round(0.5 * p_partkey - 2.0 * p_size + 7, 4) AS x, round(p_partkey + 3.0 * p_size - 1, 4) AS y, (p_partkey - 100) * 1.0 + (p_size - 20) * 2.0 < 0 AS below FROM d JOIN part USING (p_partkey)""")
def q104_geometry(read):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, _ = C.affine([[0.5, -2.0, 0, 7], [1.0, 3.0, 0, -1], [0, 0, 1, 0], [0, 0, 0, 1]], k, s, F.lit(0))
    return read("part").select("p_partkey", F.round(C.half_circle_degrees(F.atan2(s - 25.0, k % 13 - 6.0)), 6).alias("angle"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), C.below_plane(k, s, F.lit(0), (100, 20, 0), (1.0, 2.0, 0)).alias("below"))


@query(r"""SELECT p_partkey, CAST(regexp_replace(regexp_extract('T_' || (1000 + p_size) || ',' || (10 + p_partkey % 90), '([0-9]{2,},[0-9]{2})', 1), ',', '.') AS DOUBLE) AS depth, regexp_replace(regexp_replace(trim(p_size || ' ' || p_type || '#' || p_brand), '[^A-Za-z0-9_]+', '_', 'g'), '^([0-9])', '_\1') AS name,
(p_type = p_name OR contains(p_type, p_name) OR contains(p_name, p_type)) AS alike, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 0.5 END AS number, p_size * 25.4 AS mm FROM part""")
def q105_text(read):
    s, k = F.col("p_size"), F.col("p_partkey")
    return read("part").select(
        "p_partkey",
        C.depth_of_folder(F.concat(F.lit("T_"), (1000 + s).cast("string"), F.lit(","), (10 + k % 90).cast("string"))).alias("depth"),
        C.clean_name(F.concat(s.cast("string"), F.lit(" "), F.col("p_type"), F.lit("#"), F.col("p_brand"))).alias("name"),
        C.same_or_contains(F.col("p_type"), F.col("p_name")).alias("alike"),
        C.local_number(F.when(k % 3 == 0, F.lit("n/a")).when(k % 3 == 1, F.concat(s.cast("string"), F.lit(",5"))).otherwise(F.concat(s.cast("string"), F.lit(".5")))).alias("number"),
        (s * C.millimetres("in")).alias("mm"),
    )


@query(f"""WITH {WELL}, n AS (SELECT user_id, event_id, depth, CASE WHEN event_id % 10 < 4 THEN NULL ELSE value END AS value FROM well), e AS (SELECT user_id, min(depth) AS a, max(depth) AS b FROM n WHERE value IS NOT NULL GROUP BY 1)
SELECT user_id, event_id, round(value, 4) AS value FROM n JOIN e USING (user_id) WHERE depth BETWEEN a AND b""")
def q106_trim_nulls(read):
    marked = well(read).withColumn("value", F.when(F.col("event_id") % 10 < 4, -999.25).otherwise(F.col("value")))
    return T.trim_nulls(T.nulls(marked, ["value"], [-999.25, -9999.0]), "value", "depth", ["user_id"]).select("user_id", "event_id", *r4("value"))


@query("SELECT 'r_regionkey' AS name, " + ", ".join(f"max(CASE WHEN r_name = '{n}' THEN r_regionkey END) AS \"{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region")
def q107_transpose(read):
    return T.transpose(read("region").select("r_name", "r_regionkey"))


@query("""WITH t AS (SELECT DISTINCT l_partkey AS a, l_linenumber / 10.0 AS radius, l_linenumber / 4.0 AS area, l_linenumber * 1.0 AS length, 0.3 AS l0, 0.5 AS l1, l_partkey % 2 + 1 AS p0, l_linenumber % 2 + 1 AS p1 FROM lineitem)
SELECT a, round(length, 4) AS length, round(least(greatest(radius * radius / (4 * area), 0.01), 0.09), 6) AS shape_factor, round(greatest(length - l0 - l1, length * 0.01), 4) AS mid_length, round(length * area, 4) AS volume,
round(CASE WHEN p0 = 2 AND p1 = 2 THEN (l0 * 0.1 + l1 * 0.6) / (l0 + l1) WHEN p0 = 2 THEN 0.1 WHEN p1 = 2 THEN 0.6 ELSE 1 END, 6) AS porosity FROM t""")
def q108_throats(read):
    n = F.col("l_linenumber")
    t = read("lineitem").select(F.col("l_partkey").alias("a"), (n / 10.0).alias("radius"), (n / 4.0).alias("area"), (n * 1.0).alias("length"), F.lit(0.3).alias("length_0"), F.lit(0.5).alias("length_1"), (F.col("l_partkey") % 2 + 1).alias("phase_0"), (n % 2 + 1).alias("phase_1"), F.lit(0.1).alias("porosity_0"), F.lit(0.6).alias("porosity_1")).distinct()
    out = P.throat_porosity(P.throat_geometry(t))
    return out.select("a", *r4("length"), F.round("shape_factor", 6).alias("shape_factor"), *r4("mid_length", "volume"), F.round("porosity", 6).alias("porosity"))


@query("""WITH c AS (SELECT o_orderpriority AS label, o_totalprice AS v, o_custkey * 1.0 AS w, o_orderkey % 97 * 1.0 AS u FROM orders), m AS (SELECT label, avg(v) AS a, avg(w) AS b, avg(u) AS c FROM c GROUP BY 1)
SELECT label, round((avg((w - b) * (w - b)) + avg((u - c) * (u - c))), 2) AS ixx, round(-avg((w - b) * (u - c)), 4) AS iyz FROM c JOIN (SELECT label, b, c FROM m) USING (label) GROUP BY 1""")
def q109_inertia(read):
    rows = read("orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_custkey") * 1.0).alias("y"), (F.col("o_orderkey") % 97 * 1.0).alias("z"))
    return A.inertia(rows, "label", ("x", "y", "z")).select("label", F.round("ixx", 2).alias("ixx"), *r4("iyz"))
