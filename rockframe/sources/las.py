"""Well logs in LAS 2: a distributed scan and a writer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rockframe.functions.classify import millimetres

#: Numbers that stand for a missing one.
NULLS = (-999.25, -9999.25, -999.0, -9999.0, -99999.0)


def _header(lines: list[str]) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str]], dict[str, str]]:
    """Well items (name -> value, unit), curves (name, unit), all up to the data section."""
    well, curves, version, at = {}, [], {}, ""
    for x in lines:
        if x.startswith("~"):
            at = x[1:2].upper()
        elif x.strip() and not x.startswith("#") and (m := re.match(r"\s*([^.:]+?)\s*\.(\S*)\s*(.*?)\s*:([^:]*)$", x)):
            name, unit, value, _ = m.groups()
            if at == "W":
                well[name.upper()] = (value, unit)
            elif at == "C":
                curves.append((name, unit))
            elif at == "V":
                version[name.upper()] = value
    return well, curves, version


def well_name(well: dict[str, tuple[str, str]], stem: str) -> str:
    """ORIGINALWELLNAME before WELL before the file's name."""
    return next((well[k][0] for k in ("ORIGINALWELLNAME", "WELL") if well.get(k, ("",))[0]), stem)


def read_las(spark: SparkSession, path: str, nulls: tuple[float, ...] = NULLS) -> DataFrame:
    """(well, depth_mm, curve ...) of one unwrapped LAS file; NAME[i] curves become one array, missing values null.

    The header section is small and read first; rows are a text scan split in
    columns, so a long file is read in parallel.
    """
    text = spark.read.text(path)
    lines = [r[0] for r in text.limit(2000).collect()]
    end = next((i for i, x in enumerate(lines) if x[:2].upper() == "~A"), None)
    if end is None:
        raise ValueError(f"{path}: no data section within {len(lines)} lines")
    well, curves, version = _header(lines[:end])
    if version.get("WRAP", "NO").upper().startswith("Y"):
        raise ValueError(f"{path}: wrapped files aren't read")
    own = [float(well["NULL"][0])] if "NULL" in well else []
    missing = sorted({*nulls, *own})
    cells = F.split(F.trim(F.col("value")), r"\s+")
    rows = text.where(F.col("value").rlike(r"^\s*[-+.0-9]") & ~F.col("value").contains(":")).select(cells.alias("c")).where(F.size("c") == len(curves))
    value = lambda i: F.when(~F.col("c")[i].cast("double").isin(*missing), F.col("c")[i].cast("double"))
    groups: dict[str, list[tuple[int, int]]] = {}
    single = []
    for i, (n, _) in enumerate(curves[1:], 1):
        if m := re.match(r"^(.*)\[(\d+)\]$", n):
            groups.setdefault(m[1], []).append((int(m[2]), i))
        else:
            single.append((n, i))
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return rows.select(
        F.lit(well_name(well, stem)).alias("well"),
        (F.col("c")[0].cast("double") * millimetres(curves[0][1] or "m")).alias("depth_mm"),
        *[value(i).alias(n) for n, i in single],
        *[F.array(*[value(i) for _, i in sorted(g)]).alias(n) for n, g in groups.items()],
    )


def write_las(df: DataFrame, path: str, well: str = "", units: dict[str, str] | None = None, null: float = -999.25) -> None:
    """One well's curves as LAS 2: depth_mm (written in metres, ascending), then numeric columns; arrays become NAME[i].

    The rows are sorted and formatted by Spark into one text file under
    ``path``; a LAS file is one file, of one well, by nature.
    """
    units, spark = units or {}, df.sparkSession
    curves, exprs = [("DEPT", "M")], [F.col("depth_mm") / 1000]
    for f in df.schema:
        if f.name in ("depth_mm", "well"):
            continue
        if f.dataType.typeName() == "array":
            n = df.agg(F.max(F.size(f.name))).first()[0] or 0
            curves += [(f"{f.name}[{i}]", units.get(f.name, "")) for i in range(n)]
            exprs += [F.get(F.col(f.name), i) for i in range(n)]
        else:
            curves.append((f.name, units.get(f.name, "")))
            exprs.append(F.col(f.name).cast("double"))
    ends = df.agg(F.min("depth_mm").alias("a"), F.max("depth_mm").alias("b")).first()
    fmt = lambda x: f"{x:.5f}"
    top = [
        "~Version", " VERS. 2.0 : LAS 2.0", " WRAP. NO : one line per depth", "~Well",
        f" STRT.M {fmt((ends['a'] or 0) / 1000)} : start", f" STOP.M {fmt((ends['b'] or 0) / 1000)} : stop", " STEP.M 0 : step", f" NULL. {null} : null", f" WELL. {well} : well",
        "~Curve", *[f" {n}.{u} : {n}" for n, u in curves], "~ASCII",
    ]
    line = F.concat_ws(" ", *[F.format_string("%.5f", F.coalesce(e, F.lit(null))) for e in exprs])
    body = df.select((F.col("depth_mm")).alias("k"), line.alias("value"))
    header = spark.createDataFrame([(float(i - len(top)) - 1e15, x) for i, x in enumerate(top)], "k double, value string")
    body.unionByName(header).repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
