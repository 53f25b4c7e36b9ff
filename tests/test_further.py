import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rockframe.functions import classify as C
from rockframe.operators import labels as L
from rockframe.operators import porosity as P
from rockframe.operators import subscale as S
from rockframe.operators import tables as T
from rockframe.operators import windows as W
from rockframe.sources import loaders


def test_spiral_noise_is_the_filtered_first_harmonic(spark):
    rng, n, turns = np.random.default_rng(0), 60, 12
    z, x = np.mgrid[:n, :turns]
    data = 3 + np.cos(2 * np.pi * (x / turns + 5 * z / n)) + 0.1 * rng.normal(size=(n, turns))
    rows = [("i", int(a), int(b), float(data[a, b])) for a in range(n) for b in range(turns)]
    got = W.spiral_noise(spark.createDataFrame(rows, "image string, z int, x int, v double"), "image", "z", "x", "v", turns, 0.5).toPandas()
    noise = np.zeros((n, turns))
    noise[got["z"], got["x"]] = got["noise"]
    weight = np.zeros((n, turns))
    step = lambda i, a, b: (lambda t: t * t * (3 - 2 * t))(np.clip((i - a) / (b - a), 0, 1))
    half, low, high = max(1, round(0.5 * 0.02 * n)), round(1 / 100 * n), round(1 / 3 * n)
    column = step(np.arange(n), low - half, low + half) * (1 - step(np.arange(n), high - half, high + half))
    weight[:, 1], weight[:, -1] = column, np.roll(column[::-1], 1)
    want = np.fft.ifft2(np.fft.fft2(data - data.mean()) * weight).real
    assert np.allclose(noise, want) and np.abs(noise).max() > 0.8
    assert np.allclose(got["filtered"], data[got["z"], got["x"]] - got["noise"])


def test_noise_indicator(spark):
    rows = [("i", z, 0, float(v)) for z, v in enumerate([1, -2, 3, -4, 5])]
    got = [r["indicator"] for r in W.noise_indicator(spark.createDataFrame(rows, "image string, z int, x int, noise double"), "image", "z", "noise", 3).orderBy("z").collect()]
    m = np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(got, np.convolve(m - 3, np.ones(3) / 3, "same") + 3)


def test_steps_within_a_deviation(spark):
    v = [1.0, 1.1, 9.0, 9.1, 1.05, 1.0, 0.9, 1.0, 1.1, 9.0, 9.0]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, i int, v double")
    got = [r["v"] for r in P.remove_steps(df, "v", "i", ["g"], 3).orderBy("i").collect()]
    assert got == [1.0, 1.1, 1.1, 1.1, 1.05, 1.0, 0.9, 1.0, 1.1, 9.0, 9.0]


def test_truncated_draws(spark):
    df = spark.range(20_000)
    for log in (False, True):
        args = (2.0, 0.5, 1.0, 4.0)
        r = np.array([x[0] for x in df.select(S.truncated_gaussian(F.col("id"), *args, seed=3, log=log)).collect()])
        assert r.min() >= 1.0 - 1e-9 and r.max() <= 4.0 + 1e-9
        at = np.log10 if log else np.asarray
        n = NormalDist(float(at(2.0)), 0.5)
        a, b = n.cdf(float(at(1.0))), n.cdf(float(at(4.0)))
        assert abs(np.median(at(r)) - n.inv_cdf((a + b) / 2)) < 0.02
    again = df.select(S.truncated_gaussian(F.col("id"), *args, seed=3, log=True).alias("r"))
    assert again.agg(F.sum("r")).first()[0] == pytest.approx(r.sum())


def test_sub_scale_models(spark):
    t = spark.createDataFrame([(i / 50,) for i in range(50)], "phi double")
    radii = lambda c: [r[0] for r in t.select(c).collect()]
    assert set(radii(S.fixed_radius(0.3))) == {0.3}
    one = lambda *own: set(radii(S.throat_curve_radius(t, "phi", own, [1.0] * len(own), 0.5, 0.2)))
    assert one(0.9) == {0.1} and one(0.4, 0.9) == {0.4}
    r = radii(S.throat_curve_radius(t, "phi", [0.1, 0.2, 0.4], [0.2, 0.3, 0.5], 0.5, 0.2))
    assert r == sorted(r, reverse=True) and max(r) <= 0.4 + 1e-12 and min(r) >= 0.1 - 1e-12  # more porosity, higher pressure, less radius
    j = [0.1, 1.0, 10.0]
    assert S.leverett_pressures(j, 0.2, corey=(4.0, 3.0)) == pytest.approx([v / 2 * S.pressure(math.sqrt(4 * 0.2**2)) for v in j])
    assert S.leverett_pressures(j, 0.2, 0.5) == pytest.approx([v / 2 * S.pressure(2.5) for v in j])
    assert set(radii(S.leverett_radius(t, "phi", [1.0], [1.0], 1e-3))) == {1e-3}


def test_ramp_of_equal_limits(spark):
    t = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, 2.0, 2.0), (3.0, 2.0, 2.0), (None, 2.0, 2.0), (3.0, 2.0, 4.0), (9.0, 2.0, 4.0)], "v double, low double, high double")
    assert [r[0] for r in t.select(C.ramp_porosity(F.col("v"), F.col("low"), F.col("high"))).collect()] == [1.0, 1.0, 0.0, 0.0, 0.5, 0.0]


def test_unique_ids_and_headers(spark):
    df = spark.createDataFrame([(1, "1-2"), (2, "1-2"), (3, "1-3")], "t int, id string")
    assert [r["id"] for r in L.unique_ids(df, "id", "t").orderBy("t").collect()] == ["1-2a", "1-2b", "1-3"]
    many = L.unique_ids(spark.range(60_000).select("id", F.lit("1-2").alias("name")), "name", "id")  # more than there are characters below the surrogates
    assert many.distinct().count() == 60_000 and many.where(f"id = {0xD800 - 97}").first()["name"] == "1-2\ue000"
    at = spark.createDataFrame([(1,), (26,), (0xD800 - 97,), (0xD800 - 96,), (0x110000 - 0x800 - 97,), (0x110000 - 0x800 - 96,), (2 * (0x110000 - 0x800 - 97) + 2,)], "i int")
    assert [r[0] for r in at.select(L.letter(F.col("i"))).collect()] == ["a", "z", "\ud7ff", "\ue000", "\U0010ffff", "aa", "bb"]
    cells = spark.createDataFrame([(t, label) for t in (1, 2, 21) for label in (3, 5)], "t int, label int").withColumn("block", F.expr("t div 20"))
    assert [r["id"] for r in L.throat_ids(cells, "t", "label", ["block"]).orderBy("t").collect()] == ["3-5a", "3-5b", "3-5"]
    assert C.nominal_headers(["prof\n", "descida", "Corrida 2", "Condicao", "x"], "prof") == {"prof\n": "n depth (m)", "descida": "desc", "Corrida 2": "desc 2", "Condicao": "cond", "x": "x"}
    assert C.prefixed(["input-a b", "result-x", "input-"], "input-") == {"input-a b": "a"}
    points = spark.createDataFrame([(0.0, 0.0, 2.0), (1.0, 1.0, 1.0), (2.0, 1.0, 1.0)], "x double, y double, z double")
    assert [r[0] for r in points.select(C.in_sphere([F.col(c) for c in "xyz"], (0, 0, 0), 2.0)).collect()] == [True, True, False]


def test_loader_by_extension():
    assert loaders.loader_of("a/B.LAS").__name__ == "read_las" and loaders.loader_of("x.csv") is not None
    for name in ("a.dlis", "a.pdf", "a.mrml", "a.txt", "a"):
        with pytest.raises(NotImplementedError):
            loaders.loader_of(name)


def test_running_sums_and_numbers_over_many_parts(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(v, f"k{v % 7}") for v in values], "v int, k string").repartition(16)
    got = T.running(df, [F.desc("k"), "v"], {"s": F.col("v")}).toPandas().sort_values(["k", "v"], ascending=[False, True])
    assert np.array_equal(got["s"], got["v"].cumsum())
    numbers = T.row_numbers(df, ["v"], "n").toPandas()
    assert np.array_equal(numbers["n"], numbers["v"] + 1)
    assert T.row_numbers(df.limit(0), ["v"]).count() == 0


def test_statistics_without_null_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (-999.0,), (6.0,)], "v double")
    r = L.valid_stats(df, "v", [-999.0]).first()
    assert (r["n"], r["min"], r["max"], r["mean"]) == (3, 1.0, 6.0, 3.0) and r["std"] == pytest.approx(np.std([1, 2, 6], ddof=1))


def test_cast_numeric_and_seeded_sample(spark):
    df = spark.createDataFrame([("1", "x", 1), ("2.5", "3", 2), (None, None, 3)], "a string, b string, c int")
    assert dict(T.cast_numeric(df).dtypes) == {"a": "double", "b": "string", "c": "int"}
    ids = [sorted(r["id"] for r in T.seeded_sample(spark.range(100).repartition(k), 10, "id").collect()) for k in (1, 7)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 10


def test_intermediates_are_deleted(spark):
    from pathlib import Path

    from rockframe import runtime

    runtime.materialize(spark.range(3))
    path = Path(runtime._written[-1])
    assert path.exists() and runtime.clear_intermediates(spark) > 0 and not path.exists() and not runtime._written
