"""Writers of tables, curves and images of curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flattened(df: DataFrame, image: str) -> DataFrame:
    """(depth, value) rows of an image column, in the order of its places."""
    return df.select("depth_mm", F.posexplode(image).alias("place", "value"))


def write_curve_csv(df: DataFrame, path: str, image: str | None = None) -> None:
    """Depth in metres with six decimals, values with four; an image is written flattened. One folder of part files."""
    out = flattened(df, image) if image else df
    cells = [F.format_string("%.6f", F.col("depth_mm") / 1000).alias("depth")]
    cells += [F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in out.columns if c not in ("depth_mm", "place")]
    out.repartitionByRange("depth_mm").sortWithinPartitions("depth_mm", *(["place"] if image else [])).select(*cells).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, form: str = "tsv") -> None:
    """tsv (nulls empty), csv or parquet."""
    if form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, sep="\t" if form == "tsv" else ",", header=True, nullValue="", emptyValue="")


def histogram_curves(histogram: DataFrame, depth: str = "depth") -> DataFrame:
    """A histogram in depth (depth, bin, y) as one array per depth, for ``las.write_las``; depth counts metres."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bin", "y"))), lambda p: p["y"])
    return histogram.groupBy((F.col(depth) * 1000.0).alias("depth_mm")).agg(ordered.alias("HIST"))
