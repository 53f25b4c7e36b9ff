"""Label grids, pore networks and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import aggregates as A
from rockframe.operators import grid as G
from rockframe.operators import network as N
from rockframe.operators import tables as T
from rockframe.plans.registry import GRID, MONTH, NETWORK, grid, month, network, query, r4

_NEAR = f"{GRID}, near AS (SELECT a.label AS center, b.label AS neighbour FROM grid a JOIN grid b ON abs(a.z - b.z) <= 1 AND abs(a.x - b.x) <= 1 AND (a.z <> b.z OR a.x <> b.x) AND b.z BETWEEN a.z - 1 AND a.z + 1)"


@query(f"WITH {_NEAR}, c AS (SELECT center, neighbour, CASE WHEN center = neighbour THEN count(*) // 2 ELSE count(*) END AS n FROM near GROUP BY center, neighbour) SELECT center, neighbour, n, round(100.0 * n / sum(n) OVER (PARTITION BY neighbour), 4) AS percent FROM c WHERE center <> 4 AND neighbour <> 4".replace("WHERE center <> 4 AND neighbour <> 4", "").replace("FROM c ", "FROM (SELECT * FROM c WHERE center <> 4 AND neighbour <> 4)"))
def q51_contacts(read):
    return G.contacts(grid(read), ["z", "x"], ignore=[4], self_count=True).select("center", "neighbour", "n", *r4("percent"))


@query(f"""WITH {GRID}, p AS (SELECT a.label AS p, b.label AS q, 2.0 AS s FROM grid a JOIN grid b ON b.z = a.z + 1 AND b.x = a.x UNION ALL SELECT a.label, b.label, 3.0 FROM grid a JOIN grid b ON b.x = a.x + 1 AND b.z = a.z)
SELECT least(p, q) AS a, greatest(p, q) AS b, sum(s) AS area FROM p WHERE p <> 0 AND q <> 0 AND p <> q GROUP BY 1, 2""")
def q52_contact_areas(read):
    return G.contact_areas(grid(read), ["z", "x"], [2.0, 3.0])


@query("""WITH g AS (SELECT l_orderkey AS z, l_linenumber AS x, min(l_suppkey) AS label FROM lineitem GROUP BY 1, 2), n AS (SELECT a.label, b.label AS other FROM g a JOIN g b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND abs(a.x - b.x) <= 1 WHERE a.label <> b.label AND a.label <> 0 AND b.label <> 0)
SELECT label, count(DISTINCT other) AS neighbours FROM (SELECT label, other FROM n UNION ALL SELECT label, NULL FROM g WHERE label <> 0) GROUP BY 1""")
def q53_coordination(read):
    g = read("lineitem").groupBy(F.col("l_orderkey").alias("z"), F.col("l_linenumber").alias("x")).agg(F.min("l_suppkey").alias("label"))
    return G.coordination(g, ["z", "x"])


def _rounds(n: int) -> str:
    """Components by n rounds of taking the least name among oneself and one's neighbours: enough for paths of n edges, and the graph of all suppliers and parts has shorter ones."""
    step = "l{1} AS MATERIALIZED (SELECT l.id, least(min(l.component), min(o.component)) AS component FROM l{0} l JOIN both_ways ON a = l.id JOIN l{0} o ON o.id = b GROUP BY 1)"
    return f"WITH {NETWORK}, both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM network UNION SELECT dst, src FROM network), l0 AS (SELECT DISTINCT a AS id, a AS component FROM both_ways), " + ", ".join(step.format(i, i + 1) for i in range(n)) + f", comp AS (SELECT * FROM l{n})"


_REACH = _rounds(12)


@query(f"{_REACH} SELECT id, component FROM comp")
def q54_components(read):
    return N.clusters(network(read), "src", "dst")


@query(f"{_REACH} SELECT id, component FROM comp WHERE component IN (SELECT component FROM comp WHERE id % 10 = 0 INTERSECT SELECT component FROM comp WHERE id % 10 = 1)")
def q55_spanning_components(read):
    comps = N.clusters(network(read), "src", "dst").withColumn("face", F.col("id") % 10)
    return G.spanning(comps, "face", 0, 1).select("id", "component")


_PORES = "pores AS (SELECT p_partkey AS pore, p_size / 10.0 AS radius, 0.02 + (p_partkey % 7) / 100.0 AS shape, 1.0 + p_size / 50.0 AS length, p_retailprice AS volume, p_partkey % 2 + 1 AS phase, (p_partkey % 10) / 10.0 AS porosity, p_retailprice / 1000 AS pressure, p_partkey % 9 = 0 AS inlet, p_partkey % 9 = 1 AS outlet FROM part)"
_THROATS = "throats AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7 + l_suppkey) % (SELECT max(p_partkey) FROM part) AS b, l_linenumber / 10.0 AS radius, 0.03 + l_linenumber / 100.0 AS shape, 0.5 AS length FROM lineitem)"


def _pores(read):
    p = F.col("p_partkey")
    return read("part").select(p.alias("pore"), (F.col("p_size") / 10.0).alias("radius"), (0.02 + (p % 7) / 100.0).alias("shape"), (1.0 + F.col("p_size") / 50.0).alias("length"), F.col("p_retailprice").alias("volume"), (p % 2 + 1).alias("phase"), ((p % 10) / 10.0).alias("porosity"), (F.col("p_retailprice") / 1000).alias("pressure"), (p % 9 == 0).alias("inlet"), (p % 9 == 1).alias("outlet"))


def _throats(read):
    rows = T.beside_one(read("part"), F.max("p_partkey").alias("m")).select("m").limit(1)
    big = read("lineitem").crossJoin(F.broadcast(rows))
    return big.select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("m")).alias("b"), (F.col("l_linenumber") / 10.0).alias("radius"), (0.03 + F.col("l_linenumber") / 100.0).alias("shape"), F.lit(0.5).alias("length")).distinct()


@query(f"WITH {_PORES} SELECT round(sum(CASE WHEN phase = 1 THEN volume ELSE 0 END), 4) AS resolved, round(sum(CASE WHEN phase = 2 THEN volume ELSE 0 END), 4) AS unresolved, round(sum(CASE WHEN phase = 2 THEN volume * porosity ELSE 0 END), 4) AS unresolved_pore, round(sum(CASE WHEN phase = 1 THEN volume ELSE volume * porosity END), 4) AS pore_volume FROM pores")
def q56_network_summary(read):
    return N.network_summary(_pores(read), "volume", "phase", "porosity").select(*r4("resolved", "unresolved", "unresolved_pore", "pore_volume"))


def _k(r: str, g: str) -> str:
    a = f"({r} * {r} / (4 * {g}))"
    return f"(CASE WHEN {g} <= 0.048 THEN 0.6 * {a} * {a} * {g} WHEN {g} <= 0.07 THEN 0.5623 * {a} * {a} * {g} ELSE {a} * {r} * {r} / 8 END)"


_COND = f"{_PORES}, {_THROATS}, cond AS (SELECT t.a, t.b, t.radius, t.shape, p.inlet AS i0, p.outlet AS o0, q.inlet AS i1, q.outlet AS o1, p.pressure AS p0, q.pressure AS p1, 1 / (p.length / {_k('p.radius', 'p.shape')} + t.length / {_k('t.radius', 't.shape')} + q.length / {_k('q.radius', 'q.shape')}) AS conductance FROM throats t JOIN pores p ON p.pore = t.a JOIN pores q ON q.pore = t.b)"


@query(f"WITH {_COND} SELECT a, b, round(radius, 4) AS radius, round(conductance, 9) AS conductance FROM cond")
def q57_conductance(read):
    out = N.throat_conductance(_throats(read), _pores(read), "pore", ("a", "b"))
    return out.select("a", "b", *r4("radius"), F.round("conductance", 9).alias("conductance"))


@query(f"""WITH {_COND}, f AS (SELECT coalesce(sum(CASE WHEN (i0 AND NOT i1 AND NOT o1) OR (i1 AND NOT i0 AND NOT o0) THEN abs(p1 - p0) * conductance / 0.001 END), 0) AS inlet, coalesce(sum(CASE WHEN (o0 AND NOT i1 AND NOT o1) OR (o1 AND NOT i0 AND NOT o0) THEN abs(p1 - p0) * conductance / 0.001 END), 0) AS outlet FROM cond)
SELECT round(inlet, 4) AS inlet, round(outlet, 4) AS outlet, round((inlet + outlet) / 2, 4) AS flow FROM f""")
def q58_boundary_flow(read):
    pores = _pores(read)
    throats = N.throat_conductance(_throats(read), pores, "pore", ("a", "b")).select("a", "b", "conductance")
    return N.boundary_flow(throats, pores, "pore", ("a", "b"), 0.001).select(*r4("inlet", "outlet", "flow"))


_CURVES = f"curves AS (SELECT o_orderpriority AS sim, 1 + {MONTH('o_orderdate')} % 3 AS cycle, (o_custkey % 40) / 40.0 AS sw, power((o_custkey % 40) / 40.0, 2) * avg(o_totalprice) / 200000 AS krw, power(1 - (o_custkey % 40) / 40.0, 2) * avg(o_totalprice) / 150000 AS kro FROM orders GROUP BY 1, 2, o_custkey % 40)"


def _curves(read):
    s = F.col("c") / 40.0
    rows = read("orders").groupBy(F.col("o_orderpriority").alias("sim"), (1 + month("o_orderdate") % 3).alias("cycle"), (F.col("o_custkey") % 40).alias("c")).agg(F.avg("o_totalprice").alias("p"))
    return rows.select("sim", "cycle", s.alias("sw"), (s * s * F.col("p") / 200000).alias("krw"), ((1 - s) * (1 - s) * F.col("p") / 150000).alias("kro"))


@query(f"""WITH {_CURVES}, t AS (SELECT *, lag(sw) OVER w AS s0, lag(krw) OVER w AS w0, lag(kro) OVER w AS o0 FROM curves WHERE cycle = 2 WINDOW w AS (PARTITION BY sim ORDER BY sw)),
x AS (SELECT sim, sw, s0, w0, (krw - w0) / (sw - s0) AS dw, (kro - o0) / (sw - s0) AS d_o, o0, row_number() OVER (PARTITION BY sim ORDER BY sw) AS r FROM t WHERE s0 IS NOT NULL AND kro <= krw),
y AS (SELECT sim, s0 + (o0 - w0) / (dw - d_o) AS sw_cross, w0 + dw * (o0 - w0) / (dw - d_o) AS k_cross FROM x WHERE r = 1)
SELECT sim, round(min(sw), 4) AS swi, round(min_by(kro, sw), 4) AS kro_swi, round(max(sw), 4) AS swr, round(max_by(krw, sw), 4) AS krw_swr, round(coalesce(any_value(sw_cross), 0), 4) AS sw_cross, round(coalesce(any_value(k_cross), 0), 4) AS k_cross FROM t LEFT JOIN y USING (sim) GROUP BY sim""")
def q59_curve_points(read):
    return N.curve_points(_curves(read), "sim", "cycle", "sw", "sw", "krw", "kro").select("sim", *r4("swi", "kro_swi", "swr", "krw_swr", "sw_cross", "k_cross"))


@query(f"WITH {_CURVES} SELECT cycle, round(sw, 4) AS sw, round(avg(krw), 6) AS krw, round(avg(kro), 6) AS kro FROM curves GROUP BY cycle, sw")
def q60_mean_curve(read):
    return N.mean_curve(_curves(read), ["cycle", "sw"], ["krw", "kro"]).select("cycle", *r4("sw"), F.round("krw", 6).alias("krw"), F.round("kro", 6).alias("kro"))


@query("""WITH p AS (SELECT vec_id AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings), d AS (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d, power(a.v - b.v, 2) AS q FROM p a JOIN p b ON a.k < b.k)
SELECT CAST(ceil(d / 0.05) - 1 AS INTEGER) AS bin, round(avg(q) / 2, 6) AS gamma, count(*) AS pairs FROM d WHERE d > 0 AND d <= 0.05 * 6 GROUP BY 1""")
def q61_variogram(read):
    p = read("embeddings").select(F.col("vec_id").alias("k"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyv")])
    return G.variogram(p, ["x", "y"], "v", "k", 0.05, 6).select("bin", F.round("gamma", 6).alias("gamma"), "pairs")


_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _NAMES for b in _NAMES))
def q62_correlations(read):
    return A.correlation_long(read("lineitem"), _NAMES).select("a", "b", F.round("r", 6).alias("r"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def q63_line_fit(read):
    return A.line_fit(read("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", *r4("slope", "intercept"), F.round("r2", 6).alias("r2"), "n")


@query(f"WITH {GRID} SELECT label, count(*) AS n, round(avg(z), 4) AS mean_z, round(avg(x), 4) AS mean_x, round(covar_samp(z, z), 2) AS cov_zz, round(covar_samp(z, x), 4) AS cov_zx, round(covar_samp(x, x), 4) AS cov_xx FROM grid WHERE label <> 0 GROUP BY 1")
def q64_moments(read):
    return A.moments(grid(read), "label", ["z", "x"]).select("label", "n", *r4("mean_z", "mean_x"), F.round("cov_zz", 2).alias("cov_zz"), *r4("cov_zx", "cov_xx"))


@query(f"""WITH {GRID}, c AS (SELECT label, floor(v) AS v, count(*) AS n FROM grid WHERE label IN (1, 2) GROUP BY 1, 2), m AS (SELECT max(CASE WHEN label = 1 THEN v END) AS lo, max(CASE WHEN label = 2 THEN v END) AS hi FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS r FROM c) WHERE r = 1)
SELECT label, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE least(greatest((hi - floor(v)) / (hi - lo), 0), 1) END), 4) AS porosity, count(*) AS n FROM grid, m WHERE label <> 0 GROUP BY 1""")
def q65_microporosity(read):
    g = grid(read).withColumn("v", F.floor("v"))
    both = g.crossJoin(F.broadcast(G.porosity_limits(g, "v", "label", 1, 2))).where("label <> 0")
    phi = F.when(F.col("label") == 1, 1.0).otherwise(C.ramp_porosity(F.col("v"), F.col("low"), F.col("high")))
    return both.groupBy("label").agg(F.round(F.avg(phi), 4).alias("porosity"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRID} SELECT z, " + ", ".join(f"round(coalesce(count(*) FILTER (label = {k}) / nullif(count(*) FILTER (label <> 0), 0), 0), 6) AS label_{k}" for k in range(5)) + " FROM grid GROUP BY z")
def q66_row_proportions(read):
    out = G.row_proportions(grid(read), "z", "label", range(5), 0)
    return out.select("z", *[F.round(f"label_{k}", 6).alias(f"label_{k}") for k in range(5)])


@query(f"WITH {GRID} SELECT label, CAST(min(z) AS BIGINT) AS z_min, min(x) AS x_min, CAST(max(z) AS BIGINT) AS z_max, max(x) AS x_max FROM grid WHERE label <> 0 GROUP BY 1")
def q75_bounding_boxes(read):
    return G.box(grid(read).where("label <> 0"), ["z", "x"], ["label"])


@query(f"""WITH {_THROATS}, u AS (SELECT a AS pore, shape, radius * radius AS area FROM throats UNION ALL SELECT b, shape, radius * radius FROM throats) SELECT pore, round(sum(shape * area) / sum(area) + 1e-9, 6) AS shape FROM u GROUP BY 1""")
def q76_pore_shape_factors(read):
    t = _throats(read).withColumn("area", F.col("radius") * F.col("radius"))
    return N.pore_shape_factors(t, ("a", "b"), "shape", "area").select("pore", F.round(F.col("shape") + 1e-9, 6).alias("shape"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM c) WHERE r = 1""")
def q77_mode(read):
    return A.mode_value(read("part"), ["p_brand"], "p_size")


