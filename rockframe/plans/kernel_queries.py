"""Geometry, block filters, clusters, intrusion. Filters are checked by SQL; shapes, fits and intrusion have tests on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rockframe.operators import blocks as B
from rockframe.operators import geometry as S
from rockframe.operators import models as M
from rockframe.plans.registry import query, r4


def _image(read):
    """A dense picture out of lineitem: y and x from keys, a label and a value."""
    li = read("lineitem")
    return li.groupBy((F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") % 64).cast("int").alias("x")).agg((F.min("l_orderkey") % 6).cast("int").alias("label"), F.avg("l_quantity").alias("v"))


@query()
def q80_object_shapes(read):
    report = S.object_shapes_2d(_image(read))
    return S.report_order(report, 1.0)


@query()
def q81_principal_axes(read):
    cells = read("lineitem").select((F.col("l_orderkey") % 50).alias("z"), (F.col("l_partkey") % 40).alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_suppkey") % 7).cast("int").alias("label")).distinct()
    return S.object_shapes_3d(cells).select("label", "n", *r4(*S.SHAPE_3D))


_IMAGE = "image AS (SELECT CAST(l_partkey % 64 AS INTEGER) AS y, CAST(l_suppkey % 64 AS INTEGER) AS x, CAST(min(l_orderkey) % 6 AS INTEGER) AS label, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_BESIDE = "SELECT a.y, a.x, round({0}, 6) AS {1} FROM image a CROSS JOIN (SELECT CAST(unnest(range(-{2}, {2} + 1)) AS INTEGER) AS dy) CROSS JOIN (SELECT CAST(unnest(range(-{2}, {2} + 1)) AS INTEGER) AS dx) JOIN image b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2".format


@query(f"WITH {_IMAGE} {_BESIDE('median(b.v)', 'v', 1)}")
def q82_median_filter(read):
    return B.filter_blocks(_image(read), "v", B.median(1), 1, block=16).select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {_IMAGE} {_BESIDE('sum(b.v * exp(-(dy * dy + dx * dx) / 2.0)) / sum(exp(-(dy * dy + dx * dx) / 2.0))', 'v', 2)}")
def q83_gaussian_filter(read):
    return B.filter_blocks(_image(read), "v", B.gaussian(1.0, 2), 2, block=16).select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {_IMAGE} {_BESIDE('least(6.0, coalesce(min(CASE WHEN b.label = 0 THEN sqrt(dy * dy + dx * dx) END), 6.0))', 'solid', 6)}")
def q84_distance(read):
    image = _image(read).withColumn("solid", (F.col("label") != 0).cast("int"))
    return B.filter_blocks(image, "solid", B.distance_to_background(6), 6, block=16).select("y", "x", F.round("solid", 6).alias("solid"))


@query()
def q85_kmeans_classes(read):
    spark = read("region").sparkSession
    bounds = M.kmeans_thresholds(read("lineitem"), "l_extendedprice", 3)
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(bounds)], "class int, upper double")


@query()
def q86_table_kmeans(read):
    return M.kmeans(read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query()
def q87_intrusion(read):
    throats = read("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"), (F.col("l_discount") * 100).alias("entry")).distinct()
    pores = throats.select(F.col("a").alias("pore")).union(throats.select("b")).distinct().select("pore", F.lit(1.0).alias("volume"), (F.col("pore") % 50 == 0).alias("inlet"))
    return M.intrusion(pores, throats, [2.0, 6.0, 10.0])
