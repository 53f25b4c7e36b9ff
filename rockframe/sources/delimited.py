"""Delimited files whose separator, decimal sign and header are found out first."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rockframe.functions.classify import local_number, millimetres


def count_outside_quotes(line: str, char: str) -> int:
    """How often a separator occurs outside double quotes."""
    return sum(part.count(char) for part in line.split('"')[::2])


def sniff(lines: Sequence[str], allowed: Sequence[str] = (";", ",")) -> str:
    """The first allowed separator that all lines have equally often, and at least once; else the first allowed one."""
    for c in allowed:
        counts = {count_outside_quotes(x, c) for x in lines if x.strip()}
        if len(counts) == 1 and counts != {0}:
            return c
    return allowed[0]


def head(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    """The first lines of the first file under a path, read by Spark (so any store will do)."""
    first = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").limit(n).collect()
    return [r["value"] for r in first]


def header_row(lines: Sequence[str], separator: str) -> int:
    """The number of the first line without an empty cell, of as many cells as the widest line."""
    rows = [[c.strip().strip('"') for c in x.split(separator)] for x in lines]
    width = max(map(len, rows), default=0)
    return next((i for i, r in enumerate(rows) if len(r) == width and all(r)), 0)


def read_delimited(spark: SparkSession, path: str, allowed: Sequence[str] = (";", ",")) -> DataFrame:
    """All rows under the first full line as strings, numbers with a comma read if the separator is a semicolon.

    The driver sees a bounded number of lines; the scan itself is Spark's.
    Columns of which every cell is a number become doubles where decimals are
    commas; otherwise Spark infers types from the whole file.
    """
    lines = head(spark, path)
    sep = sniff(lines, allowed)
    top = header_row(lines, sep)
    names = [c.strip().strip('"') for c in lines[top].split(sep)] if lines else []
    schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    df = spark.read.csv(path, sep=sep, schema=schema, mode="PERMISSIVE")
    skip = [x for x in lines[: top + 1]]
    key = F.concat_ws(sep, *[F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) for n in schema.names])
    junk = [sep.join([c.strip().strip('"') for c in x.split(sep)] + [""] * (len(names) - len(x.split(sep)))) for x in skip]
    df = df.where(~key.isin(*junk)).where(F.coalesce(*[F.col(f"`{n}`") for n in schema.names]).isNotNull())
    return numeric(df, comma=sep == ";")


def numeric(df: DataFrame, comma: bool) -> DataFrame:
    """String columns without a cell that isn't a number become doubles; one aggregate decides for all."""
    read = (lambda c: local_number(F.trim(c))) if comma else (lambda c: F.trim(c).try_cast("double"))
    cols = {n: F.col(f"`{n}`") for n in df.columns}
    bad = df.agg(*[F.coalesce(F.max(c.isNotNull() & read(c).isNull()), F.lit(True)).alias(f"b{i}") for i, c in enumerate(cols.values())]).first()
    return df.select(*[(c if bad[i] else read(c)).alias(n) for i, (n, c) in enumerate(cols.items())])


_INDEXED = re.compile(r"^(.*)\[(\d+)\]$")


def read_well_csv(spark: SparkSession, path: str) -> DataFrame:
    """A well log: depth in millimetres, curves, and indexed columns NAME[i] as one array.

    Units stand in the header (``Depth (m)``) or in the row below it. Curve
    values under 0.001 become 0.001, those of images don't; numbers of an image
    must follow each other evenly.
    """
    lines = head(spark, path)
    sep = sniff(lines, (";", ","))
    top = header_row(lines, sep)
    names = [c.strip() for c in lines[top].split(sep)]
    units = [m[1] if (m := re.search(r"\(([^)]*)\)\s*$", n)) else None for n in names]
    second = [c.strip() for c in lines[top + 1].split(sep)] if len(lines) > top + 1 else []
    below = second and not any(re.match(r"^-?[\d.,]+$", c) for c in second)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(path, sep=sep, schema=schema)
    value = (lambda c: local_number(F.trim(c))) if sep == ";" else (lambda c: F.trim(c).try_cast("double"))
    factor = millimetres((second[0] if below else units[0]) or "m")
    plain = [re.sub(r"\s*\([^)]*\)\s*$", "", n) for n in names]
    groups: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(plain[1:], 1):
        if m := _INDEXED.match(n):
            groups.setdefault(m[1], []).append((int(m[2]), i))
    for name, members in groups.items():
        steps = {b[0] - a[0] for a, b in zip(sorted(members), sorted(members)[1:], strict=False)}
        if len(steps) > 1:
            raise ValueError(f"image {name} isn't evenly numbered")
    single = [(n, i) for i, n in enumerate(plain[1:], 1) if not _INDEXED.match(n)]
    low = lambda c: F.when(c < 0.001, 0.001).otherwise(c)
    return raw.where(value(F.col("c0")).isNotNull()).select(
        (value(F.col("c0")) * factor).alias("depth_mm"),
        *[low(value(F.col(f"c{i}"))).alias(n) for n, i in single],
        *[F.array(*[value(F.col(f"c{i}")) for _, i in sorted(g)]).alias(n) for n, g in groups.items()],
    )
