"""Instance reports in folders named by depth, in several versions of their schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rockframe.functions.classify import depth_of_folder

_SHAPE = ["aspect_ratio", "elongation", "eccentricity"]
_V5 = ["label", "voxelCount", "area (mm^2)", "angle (deg)", "max_feret (mm)", "min_feret (mm)", *_SHAPE, "ellipse_perimeter (mm)", "ellipse_area (mm^2)", "ellipse_perimeter_over_ellipse_area (1/mm)", "perimeter (mm)", "perimeter_over_area (1/mm)", "gamma"]
_PLAIN = [re.sub(r" \(.*\)$", "", c) for c in _V5]
#: The columns each version of a report must have, oldest first.
VERSIONS = [
    ["Label", *[c for c in _PLAIN if c not in ("label", "gamma")], "mean_feret", "pore_size_class_label"],
    ["Label", *[c for c in _PLAIN if c not in ("label", "gamma")], "mean_feret"],
    [*[c for c in _PLAIN if c != "gamma"], "mean_feret"],
    [*_PLAIN, "mean_feret"],
    [*_V5, "mean_feret (mm)"],
    _V5,
]


def report_version(columns: list[str]) -> int | None:
    """The newest version whose columns are all there."""
    fit = [i for i, need in enumerate(VERSIONS) if set(need) <= set(columns)]
    return max(fit, default=None)


def canonical(df: DataFrame) -> DataFrame:
    """Columns under their newest names without units."""
    return df.withColumnsRenamed({c: "label" if c == "Label" else re.sub(r"\s*\([^)]*\)$", "", c) for c in df.columns})


def read_reports(spark: SparkSession, root: str, pattern: str = "*Report*.tsv") -> DataFrame:
    """(depth_m, canonical columns) of all reports under ``root``, the newest file of each folder.

    Files of equal headers are read in one scan; which files there are, and
    their first lines, is one small query. A file of no known version is left out.
    """
    files = spark.read.text(root, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_block_start").alias("o"), "value")
    heads = files.where(F.col("value").contains("oxelCount")).groupBy("f", "t").agg(F.first("value").alias("head"))
    rows = heads.withColumn("folder", F.regexp_extract("f", r"^(.*)/[^/]*$", 1)).collect()
    known: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["f"])):
        if report_version(r["head"].split("\t")) is not None:
            known[r["folder"]] = (r["f"], r["head"])
    out = None
    for head in sorted({h for _, h in known.values()}):
        paths = [f for f, h in known.values() if h == head]
        one = spark.read.csv(paths, sep="\t", header=True, inferSchema=True).withColumn("depth_m", depth_of_folder(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)))
        one = canonical(one)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no report of a known version under {root}")
    return out


def read_variables(spark: SparkSession, root: str, pattern: str = "*Variables*.tsv") -> DataFrame:
    """(depth_m, property, value): key and value files, one row per key; a key that a depth lacks has no row, so a pivot gives null."""
    raw = spark.read.csv(root, sep="\t", header=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)
    rows = raw.select(depth_of_folder(folder).alias("depth_m"), F.trim("Properties").alias("property"), F.col("Values").alias("value"), F.col("_metadata.file_modification_time").alias("t"))
    newest = Window.partitionBy("depth_m", "property").orderBy(F.desc("t"))
    return rows.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r", "t")
