"""Raw volumes: shape and type from the file name, voxels as rows or slabs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names in file names.
KINDS = {"BIN": "u1", "BIW": "u1", "MANGO": "u1", "BASINS": "u4", "PSD": "u4", "MICP": "u4", "CT": "u2", "LABELS": "i4", "FLOAT": "f4", "KABS": "f8"}


def describe(name: str) -> dict:
    """Type, shape (z, y, x) and voxel size in nanometres of WELL_SAMPLE_STATE_TYPE_nx_ny_nz_sizenm.raw."""
    m = re.search(r"_([A-Z0-9]+)_(\d{2,5})_(\d{2,5})_(\d{2,5})_(\d+)nm", name.upper().replace("NM", "nm"))
    if not m:
        raise ValueError(f"file name says no shape: {name}")
    kind, nx, ny, nz, size = m.groups()
    return {"kind": kind, "dtype": KINDS.get(kind, "u2"), "shape": (int(nz), int(ny), int(nx)), "spacing_nm": int(size)}


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "u2", header: int = 0, big: bool = False) -> DataFrame:
    """(z, y, values): one row per line of voxels. Spark cuts the file in records of one line, so slabs are read in parallel."""
    kind = np.dtype(dtype).newbyteorder(">" if big else "<")
    nz, ny, nx = shape
    size = nx * kind.itemsize
    if header % size:
        raw = spark.read.format("binaryFile").load(path).select(F.explode(F.sequence(F.lit(0), F.lit(nz * ny - 1))).alias("i"), F.expr(f"substring(content, {header} + 1 + i * {size}, {size})").alias("line"))
    else:
        rdd = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda x: (x[1] - header // size, bytearray(x[0])))
        raw = spark.createDataFrame(rdd, "i bigint, line binary").where("i >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            rows = [np.frombuffer(x, kind).astype(np.float64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(i // ny, pa.int32()), pa.array(i % ny, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["z", "y", "values"])

    return raw.mapInArrow(run, "z int, y int, values array<double>")


def voxels(lines: DataFrame, value: str = "v") -> DataFrame:
    """Lines to the long form (z, y, x, v)."""
    return lines.select("z", "y", F.posexplode("values").alias("x", value))


def lines(grid: DataFrame, value: str = "v") -> DataFrame:
    """The long form back to lines, by x; absent cells are left out."""
    pairs = F.sort_array(F.collect_list(F.struct("x", value)))
    return grid.groupBy("z", "y").agg(F.transform(pairs, lambda p: p[value].cast("double")).alias("values"))


def slab(lines_: DataFrame, low: int, high: int, stride: int = 1, to: tuple[float, float] | None = None) -> DataFrame:
    """Rows low <= z < high, every ``stride``-th in all axes, rescaled from the slab's range if ``to`` is given."""
    part = lines_.where((F.col("z") >= low) & (F.col("z") < high) & ((F.col("z") - low) % stride == 0) & (F.col("y") % stride == 0))
    out = part.withColumn("values", F.filter("values", lambda v, i: i % stride == 0))
    if to:
        ends = out.agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
        out = out.crossJoin(F.broadcast(ends)).withColumn("values", F.transform("values", lambda v: (v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (to[1] - to[0]) + to[0])).drop("lo", "hi")
    return out
