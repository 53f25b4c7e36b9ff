import numpy as np
import pytest
from pyspark.sql import functions as F

from rockframe.operators import blocks
from rockframe.operators import porosity as P
from rockframe.plans import pipeline


def test_short_steps_go_and_long_ones_stay(spark):
    v = [1, 1, 5, 1, 1, 7, 7, 7, 1]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, i int, v int")
    got = [r["v"] for r in P.remove_steps(df, "v", "i", ["g"], 2).orderBy("i").collect()]
    assert got == [1, 1, 1, 1, 1, 7, 7, 7, 1]


def test_slices_agree_after_normalising(spark):
    rng = np.random.default_rng(0)
    rows = [(z, float(v * (1 + z) + z)) for z in range(4) for v in rng.uniform(0, 1, 200)]
    got = P.normalise_slices(spark.createDataFrame(rows, "z int, v double"), "z", "v", half=0)
    q = [r["q"] for r in got.groupBy("z").agg(F.percentile("v", [0.4, 0.95]).alias("q")).collect()]
    assert np.allclose(q, q[0])


def test_throats(spark):
    t = spark.createDataFrame([(1.0, 100.0, 10.0, 9.0, 0.99, 2, 1, 0.2, 0.9), (1.0, 1.0, 10.0, 1.0, 1.0, 1, 1, 0.2, 0.9)], "radius double, area double, length double, length_0 double, length_1 double, phase_0 int, phase_1 int, porosity_0 double, porosity_1 double")
    a, b = P.throat_porosity(P.throat_geometry(t)).collect()
    assert (a["shape_factor"], b["shape_factor"]) == (0.01, 0.09) and (a["mid_length"], b["mid_length"]) == (0.1, 8.0)
    assert (a["porosity"], b["porosity"]) == (0.2, 1.0)


def test_largest(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,)], "component int")
    assert {r["component"] for r in P.largest(df, 1).collect()} == {1}


def test_opening_keeps_what_a_disc_fits(spark):
    a = np.zeros((30, 30))
    a[3:12, 3:12] = 1
    a[20, 5:25] = 1
    df = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "y int, x int, v double")
    got = {r["radius"]: r["covered"] for r in blocks.size_distribution(df, "v", [1, 3], block=10).collect()}
    one = np.array([[any(a[y + i : y + i + 1, x + j : x + j + 1].size and _fits(a, y + i, x + j, 1) and i * i + j * j <= 1 for i in (-1, 0, 1) for j in (-1, 0, 1)) for x in range(30)] for y in range(30)])
    assert got[1] == one.sum() and 0 < got[3] <= got[1]


def _fits(a, y, x, r):
    ok = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
    return all(0 <= y + i < a.shape[0] and 0 <= x + j < a.shape[1] and a[y + i, x + j] for i, j in ok)


def test_chains(spark):
    @pipeline.step("keep", needs=["id"])
    def keep(df, above):
        return df.where(F.col("id") > above)

    chain = pipeline.Chain().then("keep", above=3)
    assert pipeline.Chain.load(chain.dump()).run(spark.range(6)).count() == 2
    with pytest.raises(ValueError):
        chain.run(spark.range(2).toDF("x"))
    with pytest.raises(KeyError):
        chain.then("no such step")
