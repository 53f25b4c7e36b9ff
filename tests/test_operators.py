"""Operators against values computed by hand or by brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import aggregates as A
from rockframe.operators import blocks, geometry, grid, joins, models, network, tables, windows
from rockframe.operators.components import connected_components

CELLS = [[1, 2, 3], [2, 3, 5], [4, 1, 2], [1, 5, 5]]
WANT = {1: {2: 4, 3: 2, 4: 2, 5: 4}, 2: {1: 4, 3: 4, 4: 1, 5: 4}, 3: {1: 2, 2: 4, 4: 1, 5: 2}, 4: {1: 2, 2: 1, 3: 1, 5: 1}, 5: {1: 4, 2: 4, 3: 2, 4: 1}}


@pytest.fixture(scope="module")
def picture(spark):
    return spark.createDataFrame([(y, x, v) for y, row in enumerate(CELLS) for x, v in enumerate(row)], "y int, x int, label int")


def test_neighbour_counts(picture):
    got = {(r["center"], r["neighbour"]): r["n"] for r in grid.contacts(picture, ["y", "x"]).collect() if r["n"]}
    assert got == {(a, b): n for a, row in WANT.items() for b, n in row.items()}


def test_neighbour_counts_with_self(picture):
    got = {r["center"]: r["n"] for r in grid.contacts(picture, ["y", "x"], self_count=True).collect() if r["center"] == r["neighbour"]}
    assert {k: got.get(k, 0) for k in range(1, 6)} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def test_neighbour_percent_after_ignoring(picture):
    rows = grid.contacts(picture, ["y", "x"], ignore=[4]).collect()
    assert 4 not in {r["center"] for r in rows} | {r["neighbour"] for r in rows}
    for n in (1, 2, 3, 5):
        assert sum(r["percent"] for r in rows if r["neighbour"] == n) == pytest.approx(100)


def test_components_of_path_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (201, 200), (300, 300)] + [(None, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == got[200] == 200 and got[300] == 300


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_class_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 9.0, None)], "v double")
    v = F.col("v")
    rows = df.select("v", C.size_class(v, [1, 2]).alias("a"), C.half_open_classes(v, [1, 2]).alias("b"), C.open_lower_classes(v, F.lit(0.0), [1, 2]).alias("c")).collect()
    assert [r["a"] for r in rows] == [0, 0, 1, 1, 2, None]
    assert [r["b"] for r in rows] == [0, 1, 1, 2, 2, None]
    assert [r["c"] for r in rows] == [0, 1, 2, 2, 0, 0]


def test_formula_refuses_other_text(spark):
    df = spark.createDataFrame([(4.0, 2.0)], "p double, q double")
    assert df.select(C.column_formula("sqrt(A) + B ** 2 - -1", df.columns).alias("x")).first()["x"] == 7.0
    assert df.select(C.formula("where({p} > 3 & q < 3, 10, 20)", {"p": "p", "q": "q"}).alias("x")).first()["x"] == 10.0
    for bad in ("A; drop", "Z + 1", "A +", "(A", "__import__('os')", "A B"):
        with pytest.raises(ValueError):
            C.column_formula(bad, df.columns)


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y"), (9, None)], "n int, s string")
    rule = lambda *r: tables.filter_rows(df, [tables.Filter("n", list(r))]).count()
    assert rule(tables.Rule(1, 5)) == 2 and rule() == 0 and rule(tables.Rule(1, 9, visible=False)) == 0 and rule(tables.Rule(equals="nine")) == 0
    assert tables.filter_rows(df, [tables.Filter("s", [tables.Rule(equals="y")])]).count() == 1


def test_band_join_edges_and_repeats(spark):
    a = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "n double")
    b = spark.createDataFrame([(1.5, 1), (0.5, 2), (1.51, 3)], "d double, label int")
    got = joins.band_join(a, b, "n", "d", 0.5, how="full").collect()
    assert sorted((r["n"] or 0, r["label"] or 0) for r in got) == [(0, 3), (1, 1), (1, 1), (1, 2), (1, 2), (5, 0)]


def test_interpolation_clamps_or_not(spark):
    curve = spark.createDataFrame([("w", 0.0, 0.0), ("w", 10.0, 100.0)], "w string, x double, y double")
    pts = spark.createDataFrame([("w", -1.0), ("w", 2.5), ("w", 10.0), ("w", 12.0)], "w string, at double")
    get = lambda c: [r["y"] for r in joins.interpolate_at(curve, pts, "x", "y", "at", ["w"], c).orderBy("at").collect()]
    assert get(True) == [0, 25, 100, 100] and get(False) == [None, 25, 100, None]


def test_histogram_keeps_all_mass(spark):
    v = np.random.default_rng(0).normal(size=500)
    got = A.histogram(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 13).orderBy("bin").toPandas()
    assert np.array_equal(got["y"], np.histogram(v, 13)[0])


def test_otsu_two_heaps(spark):
    v = [1] * 30 + [2] * 10 + [8] * 10 + [9] * 30
    assert A.otsu(spark.createDataFrame([(x,) for x in v], "v int"), "v").first()["threshold"] == 2


def test_winsorise_fills_null_by_mean(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert sorted(r["v"] for r in tables.winsorise(df, "v").collect()) == [1, 2, 3]


def test_even_sample_and_row_numbers(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert [r["row_number"] for r in tables.global_row_number(df, "id").orderBy("id").collect()] == list(range(1, 1001))
    assert tables.even_sample(df, "id", 10).count() == 10


def test_shapes_of_a_square():
    y, x = np.mgrid[0:11, 0:11]
    got = geometry.shape_2d(np.column_stack([y.ravel(), x.ravel()]).astype(float), (1.0, 1.0))
    assert got["voxelCount"] == 121 and got["area"] == 121 and got["perimeter"] == pytest.approx(40) and got["max_feret"] == pytest.approx(10 * 2**0.5)
    assert geometry.shape_2d(np.array([[0.0, 0], [0, 1]]), (1.0, 1.0)) is None
    assert geometry._ellipse_e(0) == pytest.approx(np.pi / 2) and geometry._ellipse_e(0.5) == pytest.approx(1.3506438810)


def test_blocks_do_not_show(spark):
    a = np.random.default_rng(1).integers(0, 9, (20, 23))
    df = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "y int, x int, v double")
    for kernel, halo in ((blocks.median(1), 1), (blocks.gaussian(1.0, 2), 2), (blocks.distance_to_background(5), 5)):
        small = blocks.filter_blocks(df, "v", kernel, halo, block=7).orderBy("y", "x").toPandas()
        whole = blocks.filter_blocks(df, "v", kernel, halo, block=64).orderBy("y", "x").toPandas()
        assert len(small) == a.size
        pd.testing.assert_frame_equal(small, whole)


def test_distance_is_euclidean():
    a = np.ones((9, 9))
    a[4, 4] = 0
    got = blocks.distance_to_background(8)(a)
    assert got[4, 4] == 0 and got[0, 4] == 4 and got[1, 0] == pytest.approx(5)


def test_permeability_of_a_chain():
    flow, pressure = models.permeability([(0, 1, 2.0), (1, 2, 2.0), (2, 3, 1.0)], {0}, {3}, 1.0)
    assert flow == pytest.approx(0.5) and pressure[1] == pytest.approx(0.75)


def test_intrusion_follows_entry_pressures(spark):
    pores = spark.createDataFrame([(i, 1.0, i == 0) for i in range(4)], "pore bigint, volume double, inlet boolean")
    throats = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 3, 1.0)], "a bigint, b bigint, entry double")
    got = {r["pressure"]: r["invaded"] for r in models.intrusion(pores, throats, [0.5, 1.0, 5.0]).collect()}
    assert got == {0.5: 1.0, 1.0: 2.0, 5.0: 4.0}


def test_response_surface_finds_its_polynomial(spark):
    rows = [(float(a), float(b), 1.0 + 2 * a - b + 3 * a * b) for a in range(5) for b in range(4)]
    got = models.response_surface(spark.createDataFrame(rows, "a double, b double, t double"), ["a", "b"], "t")
    assert got["1"] == pytest.approx(1, abs=1e-6) and got["a"] == pytest.approx(2, abs=1e-6) and got["a*b"] == pytest.approx(3, abs=1e-6)
    table = models.anova(spark.createDataFrame(rows, "a double, b double, t double"), ["a", "b"], "t")
    assert table["a*b"][0] > 1


def test_sub_network_renumbers(spark):
    pores = spark.createDataFrame([(5,), (7,), (9,)], "pore bigint")
    throats = spark.createDataFrame([(5, 7), (7, 9)], "a bigint, b bigint")
    p, t = network.sub_network(pores, throats, pores.where("pore > 5"), "pore", ("a", "b"))
    assert {(r["pore"], r["new_id"]) for r in p.collect()} == {(7, 0), (9, 1)} and [(r["new_0"], r["new_1"]) for r in t.collect()] == [(0, 1)]


def test_islands(spark):
    cells = [(0, 0, 1), (0, 1, 1), (1, 1, 1), (5, 5, 1), (0, 2, 2), (3, 3, 0)]
    got = grid.islands(spark.createDataFrame(cells, "y int, x int, label int"), ["y", "x"])
    assert sorted(r["count"] for r in got.groupBy("component").count().collect()) == [1, 1, 3]


def test_low_pass_keeps_constants():
    assert sum(windows.low_pass_taps(0.1, 21, 1.0)) == pytest.approx(1) and sum(windows.gaussian_taps(2, 4)) == pytest.approx(1)


def test_wettability_by_hand(spark):
    two, three = [(0.2, 4.0), (0.4, 2.0), (0.6, -2.0), (0.8, -4.0)], [(0.8, -4.0), (0.6, -1.0), (0.4, 1.0), (0.2, 5.0)]
    rows = [("s", c, i, s, p) for c, r in ((2, two), (3, three)) for i, (s, p) in enumerate(r)] + [("t", 2, 0, 0.3, 1.0), ("t", 2, 1, 0.7, 0.5)]
    got = {r["sim"]: r for r in network.wettability(spark.createDataFrame(rows, "sim string, cycle int, i int, sw double, pc double"), "sim", "cycle", "i", "sw", "pc").collect()}
    assert got["s"]["Iw"] == pytest.approx((0.5 - 0.2) / 0.6) and got["s"]["Io"] == pytest.approx((0.5 - 0.2) / 0.6) and got["s"]["amott"] == pytest.approx(0)
    a1, a2 = 0.1 * 2 / 2 + 0.2 * 3, 0.1 * 1 / 2 + 0.2 * 3
    assert got["s"]["usbm"] == pytest.approx((a2 - a1) / (a1 + a2))
    assert [got["t"][c] for c in ("Iw", "Io", "amott", "usbm")] == [0, 0, 0, 0]


def test_network_of_a_grid(spark):
    """Two labels side by side along x, a third apart: one throat, and only the pair spans x."""
    cells = [(z, y, x, 1 if x < 3 else 2) for z in range(2) for y in range(2) for x in range(6)] + [(z, 5, 0, 3) for z in range(2)] + [(0, 3, 3, 0)]
    pores, throats = network.extract_network(spark.createDataFrame(cells, "z int, y int, x int, label int"), (1.0, 2.0, 3.0))
    t = throats.collect()
    assert [(r["a"], r["b"], r["area"], r["length"]) for r in t] == [(1, 2, 8.0, 9.0)]
    p = {r["pore"]: r for r in pores.collect()}
    assert p[1]["volume"] == 72 and p[1]["x_min"] and not p[1]["x_max"] and p[2]["x_max"] and p[3]["y_max"]
    kept, inside = network.connected_network(pores, throats, "x_min", "x_max")
    assert {r["pore"] for r in kept.collect()} == {1, 2} and inside.count() == 1
