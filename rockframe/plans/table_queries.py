"""Filters, classes, statistics, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import aggregates as A
from rockframe.operators import grid as G
from rockframe.operators import tables as T
from rockframe.operators import windows as W
from rockframe.plans.registry import GRID, MONTH, grid, month, query, r4


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE (l_quantity BETWEEN 5 AND 10 OR l_quantity BETWEEN 20 AND 30) AND l_returnflag IN ('A', 'R')""")
def q01_table_filter(read):
    rules = [T.Filter("l_quantity", [T.Rule(5, 10), T.Rule(20, 30), T.Rule(0, 99, visible=False)]), T.Filter("l_returnflag", [T.Rule(equals="A"), T.Rule(equals="R")])]
    return T.filter_rows(read("lineitem"), rules).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("""SELECT 'l_quantity' AS col, CAST(min(l_quantity) AS VARCHAR) AS low, CAST(max(l_quantity) AS VARCHAR) AS high FROM lineitem
UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag, l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL
UNION ALL SELECT DISTINCT 'l_linenumber', CAST(l_linenumber AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem""")
def q02_default_filters(read):
    df, out = read("lineitem"), []
    for c in ("l_quantity", "l_returnflag", "l_linenumber"):
        f = T.default_filter(df, c)
        low, high = ("low", "high") if "low" in f.columns else (c, c)
        out.append(f.select(F.lit(c).alias("col"), F.col(low).cast("string").alias("low"), F.col(high).cast("string").alias("high")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH f AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1), c AS (SELECT p_brand, row_number() OVER (ORDER BY k, p_brand) AS code FROM f)
SELECT p_partkey, code, CASE WHEN p_size BETWEEN 20 AND 40 THEN 2 WHEN p_size <= 25 THEN 1 ELSE 0 END AS label, 'p_size' AS segmented_by
FROM part JOIN c USING (p_brand) WHERE p_size <= 40""")
def q03_codes_and_relabel(read):
    codes = T.first_seen_codes(read("part"), "p_brand", "p_partkey")
    labels = T.relabel(codes, [[T.Filter("p_size", [T.Rule(0, 25)])], [T.Filter("p_size", [T.Rule(20, 40)])]])
    return T.export_selection(labels, "p_size").select("p_partkey", "code", "label", "segmented_by")


@query("""WITH c AS (SELECT CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 45 THEN 3 ELSE 4 END AS size_class, l_extendedprice AS v FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08)
SELECT size_class, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(coalesce(stddev_samp(v), 0), 4) AS std, round(max(v), 4) AS max, round(min(v), 4) AS min, count(*) AS quantity, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM c GROUP BY 1""")
def q04_class_statistics(read):
    rows = T.filter_rows(read("lineitem"), [T.Filter("l_discount", [T.Rule(0.02, 0.08)])])
    rows = rows.select(C.size_class(F.col("l_quantity"), [5, 15, 30, 45]).alias("size_class"), "l_extendedprice")
    return A.group_statistics(rows, ["size_class"], "l_extendedprice").orderBy(F.desc("quantity"), "mean")


@query(f"WITH {GRID} SELECT label, count(*) AS n, CAST((SELECT count(*) FROM grid) AS BIGINT) AS total FROM grid WHERE label <> 0 GROUP BY 1")
def q05_label_counts(read):
    return A.label_counts(grid(read))


@query(f"""WITH {GRID}, c AS (SELECT label, count(*) AS n FROM grid GROUP BY 1)
SELECT label, n, round(100.0 * n / (SELECT sum(n) FROM c), 5) AS percent, round(100.0 * n / (SELECT sum(n) FROM c WHERE label IN (1, 2)), 5) AS percent_selected FROM c WHERE label IN (1, 2)""")
def q06_segment_proportions(read):
    counts = grid(read).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.col("label").isin(1, 2)
    both = T.beside_one(counts, F.sum("n").alias("t"), F.sum(F.when(chosen, F.col("n"))).alias("s")).where(chosen)
    return both.select("label", "n", F.round(100.0 * F.col("n") / F.col("t"), 5).alias("percent"), F.round(100.0 * F.col("n") / F.col("s"), 5).alias("percent_selected"))


@query("""WITH c AS (SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 40 THEN 3 ELSE 4 END AS pore_size_class FROM part)
SELECT pore_size_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS share FROM c GROUP BY 1""")
def q07_class_proportions(read):
    return A.proportions(read("part").select(C.size_class(F.col("p_size"), [10, 20, 30, 40]).alias("pore_size_class")), "pore_size_class", 3)


@query("""SELECT CASE WHEN regexp_matches(p_type, '(?i)econ') THEN 'economy' WHEN regexp_matches(p_type, '(?i)^(small|medium)') THEN 'modest' WHEN regexp_matches(p_type, '(?i)o') THEN 'round' ELSE 'other' END AS phase,
round(sum(p_retailprice), 4) AS volume, count(*) AS n FROM part GROUP BY 1""")
def q08_phase_volumes(read):
    phase = C.first_match(F.col("p_type"), {"economy": "econ", "modest": "^(small|medium)", "round": "o"})
    return read("part").groupBy(phase.alias("phase")).agg(F.round(F.sum("p_retailprice"), 4).alias("volume"), F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT p_brand, p_retailprice AS x, p_size / sum(p_size) OVER (PARTITION BY p_brand) AS f FROM part)
SELECT p_brand, round(sum(f * x), 4) AS voigt, round(1 / sum(f / x), 4) AS reuss, round((sum(f * x) + 1 / sum(f / x)) / 2, 4) AS hill FROM f GROUP BY 1""")
def q09_moduli(read):
    parts = read("part").withColumn("f", F.col("p_size") / F.sum("p_size").over(Window.partitionBy("p_brand")))
    return A.moduli(parts, ["p_brand"], "p_retailprice", "f").withColumn("hill", (F.col("voigt") + F.col("reuss")) / 2).select("p_brand", *r4("voigt", "reuss", "hill"))


@query(f"SELECT {MONTH('l_shipdate')} AS depth, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount FROM lineitem GROUP BY 1")
def q10_weighted_mean_in_depth(read):
    rows = read("lineitem").withColumn("depth", month("l_shipdate"))
    return A.weighted_mean(rows, ["depth"], ["l_extendedprice", "l_discount"], "l_quantity").select("depth", F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_discount", 6).alias("l_discount"))


_HIST = """WITH e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {n} AS w FROM ({rows})), b AS (SELECT CAST(unnest(range({n})) AS INTEGER) AS bin),
c AS (SELECT CAST(least(floor((v - lo) / w), {n} - 1) AS INTEGER) AS bin, sum(wt) AS y FROM ({rows}), e GROUP BY 1)
SELECT bin, round(lo + bin * w + 1e-7, 4) AS low, round(lo + (bin + 1) * w + 1e-7, 4) AS high, round(coalesce(y, 0), 4) AS y FROM b CROSS JOIN e LEFT JOIN c USING (bin)"""


def _edges():
    """Edges rounded a little above, away from ties."""
    return [F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("low", "high")]


@query(_HIST.format(n=20, rows="SELECT l_extendedprice AS v, 1.0 AS wt FROM lineitem"))
def q11_histogram(read):
    return A.histogram(read("lineitem"), "l_extendedprice", 20).select("bin", *_edges(), *r4("y"))


@query(_HIST.format(n=16, rows="SELECT o_totalprice AS v, (o_custkey % 7) / 8.0 AS wt FROM orders"))
def q12_weighted_histogram(read):
    return A.histogram(read("orders").withColumn("w", (F.col("o_custkey") % 7) / 8), "o_totalprice", 16, weight="w").select("bin", *_edges(), *r4("y"))


_DEPTH = f"""WITH r AS (SELECT {MONTH('o_orderdate')} AS d, o_totalprice AS v FROM orders WHERE o_totalprice > 0), e AS (SELECT min(v) AS lo, ln(max(v) / min(v)) / 12 AS ratio FROM r),
c AS (SELECT d, CAST(least(floor(ln(v / lo) / ratio + 1e-9), 11) AS INTEGER) AS bin, count(*) * 1.0 AS n FROM r, e GROUP BY 1, 2),
f AS (SELECT d, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT d FROM r) CROSS JOIN (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin) LEFT JOIN c USING (d, bin))
SELECT d AS depth, bin, round(lo * exp(ratio * (bin + 0.5)), 2) AS x, round(%s, 6) AS y FROM f, e"""


def _months(read):
    return read("orders").withColumn("depth", month("o_orderdate"))


@query(_DEPTH % "n / sum(n) OVER (PARTITION BY d)")
def q13_depth_histogram(read):
    return A.depth_histogram(_months(read), "depth", "o_totalprice", 12).select("depth", "bin", F.round("x", 2).alias("x"), F.round("y", 6).alias("y"))


@query(_DEPTH % "n * 5.0 / max(n) OVER (PARTITION BY d)")
def q14_depth_histogram_scaled(read):
    return A.depth_histogram(_months(read), "depth", "o_totalprice", 12, height=5.0).select("depth", "bin", F.round("x", 2).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH b AS (SELECT CAST(unnest(range(24)) AS INTEGER) AS bin), c AS (SELECT CAST(least(floor((l_partkey % 360) / 15.0), 23) AS INTEGER) AS bin, count(*) * 1.0 AS y FROM lineitem GROUP BY 1)
SELECT bin, bin * 15.0 AS low, coalesce(y, 0) AS y FROM b LEFT JOIN c USING (bin)""")
def q15_rose_histogram(read):
    return A.histogram(read("lineitem").select((F.col("l_partkey") % 360).alias("angle")), "angle", 24, 0, 360).select("bin", "low", "y")


@query("""WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS cdf FROM c),
g AS (SELECT CAST(i AS INTEGER) AS i, exp(i * ln(50.0) / 10) AS edge FROM (SELECT unnest(range(11)) AS i)),
h AS (SELECT i, edge, coalesce((SELECT max(cdf) FROM f WHERE v <= edge + 1e-9), 0) AS at FROM g)
SELECT a.i AS bin, round(sqrt(a.edge * b.edge), 4) AS centre, round(100 * (b.at - a.at), 4) AS y FROM h a JOIN h b ON b.i = a.i + 1""")
def q16_psd_rebin(read):
    import math

    cdf = A.value_cdf(read("lineitem"), "l_quantity").select("l_quantity", "cdf")
    edges = [math.exp(i * math.log(50.0) / 10) for i in range(11)]
    at = [F.coalesce(F.max(F.when(F.col("l_quantity") <= e + 1e-9, F.col("cdf"))), F.lit(0.0)) for e in edges]
    one = cdf.agg(F.array(*at).alias("at"))
    out = one.select(F.posexplode(F.expr(f"transform(sequence(1, {len(edges) - 1}), i -> 100 * (at[i] - at[i - 1]))")).alias("bin", "y"))
    centre = F.array(*[F.lit(math.sqrt(a * b)) for a, b in zip(edges, edges[1:], strict=False)])
    return out.select("bin", F.round(centre[F.col("bin")], 4).alias("centre"), F.round("y", 4).alias("y"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_quantity > (SELECT min(l_quantity) FROM lineitem) AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 30 THEN 2 WHEN l_quantity > 30 AND l_quantity <= 45 THEN 3 ELSE 0 END AS class FROM lineitem) GROUP BY 1""")
def q17_open_lower_classes(read):
    both = T.beside_one(read("lineitem").select("l_quantity"), F.min("l_quantity").alias("lo"))
    return both.groupBy(C.open_lower_classes(F.col("l_quantity"), F.col("lo"), [10, 30, 45]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 45 THEN 2 ELSE 3 END AS class, count(*) AS n FROM lineitem GROUP BY 1")
def q18_half_open_classes(read):
    return read("lineitem").groupBy(C.half_open_classes(F.col("l_quantity"), [10, 30, 45]).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_quantity AS v, count(*) * 1.0 AS n FROM lineitem GROUP BY 1), s AS (SELECT v, sum(n) OVER (ORDER BY v) AS w0, sum(n * v) OVER (ORDER BY v) AS s0, sum(n) OVER () AS w, sum(n * v) OVER () AS s FROM c)
SELECT v AS threshold, round(w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2) / (w * w), 4) AS variance FROM s WHERE w > w0 ORDER BY round(w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2) / (w * w), 9) DESC, v LIMIT 1""")
def q19_otsu(read):
    return A.otsu(read("lineitem"), "l_quantity").select("threshold", *r4("variance"))


@query("""WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), f AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS c FROM c), p AS (SELECT v, c, lag(v) OVER (ORDER BY v) AS v0, lag(c) OVER (ORDER BY v) AS c0 FROM f)
SELECT q, (SELECT round(coalesce(v0 + (q - c0) / (c - c0) * (v - v0), v), 4) FROM p WHERE c >= q ORDER BY v LIMIT 1) AS marker FROM (SELECT unnest([0.1, 0.25, 0.5, 0.9]) :: DOUBLE AS q)""")
def q20_cdf_markers(read):
    cdf, out = A.value_cdf(read("part"), "p_size"), None
    for q in (0.1, 0.25, 0.5, 0.9):
        one = A.cdf_marker(cdf, "p_size", q).select("q", *r4("marker"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT p_brand, p_size, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) / sum(n) OVER (PARTITION BY p_brand) AS c FROM c)
SELECT p_brand, p_size, round(coalesce(100 * (c - lag(c) OVER (PARTITION BY p_brand ORDER BY p_size)), 0), 6) AS frequency FROM f""")
def q21_frequency(read):
    cdf = A.value_cdf(read("part"), "p_size", by=["p_brand"])
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return cdf.select("p_brand", "p_size", F.round(F.coalesce(100 * (F.col("cdf") - F.lag("cdf").over(w)), F.lit(0.0)), 6).alias("frequency"))


@query("SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS new_label FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1")
def q22_renumber_by_size(read):
    lines = G.sequential(read("lineitem").select("l_suppkey"), "l_suppkey", by_size=True).where("l_suppkey <> 0")
    return lines.groupBy("l_suppkey", "new_label").agg(F.count(F.lit(1)).alias("n")).select("l_suppkey", "n", "new_label")


@query(f"""WITH m AS (SELECT o_orderpriority AS g, {MONTH('o_orderdate')} AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT g, m, round(v / last_value(v) OVER (PARTITION BY g ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS normalised FROM m""")
def q23_normalise_by_last(read):
    m = read("orders").groupBy(F.col("o_orderpriority").alias("g"), month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    return W.by_last(m, "v", "m", ["g"]).select("g", "m", F.round("normalised", 6).alias("normalised"))


@query("""WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, round(e, 6) AS equalised FROM part JOIN (SELECT p_size, sum(n) OVER (ORDER BY p_size) / sum(n) OVER () AS e FROM c) USING (p_size)""")
def q24_equalise(read):
    return A.equalise(read("part"), "p_size").select("p_partkey", F.round("equalised", 6).alias("equalised"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 150000 - 150000 * 0.2 AND 150000 + 150000 * 0.2 AND o_custkey BETWEEN 50 AND 150")
def q39_within_fraction(read):
    near = T.within_fraction(read("orders"), {"o_totalprice": (150000.0, 0.2), "o_custkey": (100, 0.5)})
    return T.within_ranges(near, {"o_custkey": (0, 10**9), "no_such": (0, 1)}).select("o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem), k AS (SELECT count(*) AS kept FROM lineitem, s WHERE abs(l_extendedprice - m) <= 1.5 * s),
u AS (SELECT least(l_extendedprice, m + 1.5 * s) AS v FROM lineitem, s), t AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM u), w AS (SELECT greatest(v, m - 1.5 * s) AS v FROM u, t)
SELECT kept, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 4) AS mean FROM w, k GROUP BY kept""")
def q40_sigma_and_winsorise(read):
    rows = read("lineitem").select("l_extendedprice")
    kept = T.sigma_filter(rows, "l_extendedprice", 1.5).agg(F.count(F.lit(1)).alias("kept"))
    v = T.winsorise(rows, "l_extendedprice", 1.5).agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_extendedprice").alias("mean"))
    return kept.crossJoin(v).select("kept", *r4("low", "high", "mean"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN sqrt(l_extendedprice) * 2 ELSE power(l_quantity, 2) / (1 + l_discount) END, 4) AS result FROM lineitem")
def q67_column_formula(read):
    df = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return df.select("l_orderkey", "l_linenumber", F.round(C.column_formula("where(C > 25, sqrt(D) * 2, C ** 2 / (1 + E))", df.columns), 4).alias("result"))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n, max(o_totalprice) OVER () AS m FROM orders)
SELECT o_orderkey, o_totalprice FROM n WHERE (i - 1) % greatest(1, (n + 99) // 100) = 0 OR o_totalprice = m""")
def q68_even_sample(read):
    return T.even_sample(read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, keep_max="o_totalprice")


@query("""WITH b AS (SELECT unnest(range((SELECT CAST(max(l_quantity) AS BIGINT) + 1 FROM lineitem))) AS bin), c AS (SELECT CAST(l_quantity AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
def q69_conditional_bins(read):
    return A.conditional_bins(read("lineitem"), "l_quantity", {"l_returnflag": "A", "l_linestatus": "F"})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS \"distinct\" FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q70_rollup(read):
    return A.distinct_statistics(read("lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey").drop("approximate")


