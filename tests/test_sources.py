import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from rockframe.sources import delimited, las, raw, reports, sinks
from rockframe.streaming import windows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_separators():
    assert delimited.count_outside_quotes('a,"b,c",d', ",") == 2
    assert delimited.sniff(["a;b", "1,5;2"]) == ";" and delimited.sniff(["a,b", '"x;y",2']) == "," and delimited.sniff([]) == ";"


def test_title_rows_and_decimal_commas(spark, tmp_path):
    p = write(tmp_path / "t.csv", "A title;;\nname;depth;v\nx;1.234,5;2,25\ny;7;\n;;\n")
    rows = delimited.read_delimited(spark, p).orderBy("name").collect()
    assert [(r["name"], r["depth"], r["v"]) for r in rows] == [("x", 1234.5, 2.25), ("y", 7.0, None)]


def test_well_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", "DEPTH,POR,PERM\nm,v/v,mD\n1.5,0.2,3\n2.0,0.0,4\n")
    assert [(r["depth_mm"], r["POR"]) for r in delimited.read_well_csv(spark, p).orderBy("depth_mm").collect()] == [(1500.0, 0.2), (2000.0, 0.001)]
    p = write(tmp_path / "b.csv", "MD (cm),AMP[0],AMP[1],AMP[2]\n1,0,5,6\n")
    assert tuple(delimited.read_well_csv(spark, p).first()) == (10.0, [0.0, 5.0, 6.0])
    p = write(tmp_path / "c.csv", "MD (cm),AMP[0],AMP[1],AMP[3]\n1,0,5,6\n")
    with pytest.raises(ValueError):
        delimited.read_well_csv(spark, p)


def test_las_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1000.0, 1.5, [1.0, 2.0]), (2000.0, None, [3.0, 4.0])], "depth_mm double, GR double, IMG array<double>")
    las.write_las(df, str(tmp_path / "w.las"), "W-1", {"GR": "api"})
    got = las.read_las(spark, str(tmp_path / "w.las")).orderBy("depth_mm").collect()
    assert [tuple(r) for r in got] == [("W-1", 1000.0, 1.5, [1.0, 2.0]), ("W-1", 2000.0, None, [3.0, 4.0])]


def test_reports_newest_of_each_folder(spark, tmp_path):
    head, row = "\t".join(reports.VERSIONS[5]), "\t".join(["1", "10"] + ["0.5"] * 13)
    write(tmp_path / "T_5050,00" / "a_Report.tsv", f"{head}\n{row}\n")
    old = write(tmp_path / "T_5051.50" / "old_Report.tsv", f"{head}\n{row}\n{row}\n")
    os.utime(old, (time.time() - 1000,) * 2)
    write(tmp_path / "T_5051.50" / "new_Report.tsv", f"{head}\n{row}\n")
    write(tmp_path / "T_5053-25" / "x_Report.tsv", "voxelCount\tother\n1\t2\n")
    got = reports.read_reports(spark, str(tmp_path)).select("depth_m", "label", "area", "gamma").collect()
    assert sorted(r["depth_m"] for r in got) == [5050.0, 5051.5]
    assert reports.report_version(["x"]) is None and reports.report_version([*reports.VERSIONS[0], "x"]) == 1


def test_variables_align_by_depth(spark, tmp_path):
    write(tmp_path / "T_10,00" / "a_Variables.tsv", "Properties\tValues\nporosity\t0.1\ndensity\t2\n")
    write(tmp_path / "T_11,00" / "a_Variables.tsv", "Properties\tValues\ndensity\t3\n")
    wide = reports.read_variables(spark, str(tmp_path)).groupBy("depth_m").pivot("property", ["density", "porosity"]).agg(F.first("value"))
    assert sorted(map(tuple, wide.collect())) == [(10.0, "2", "0.1"), (11.0, "3", None)]


def test_raw_volume(spark, tmp_path):
    p = tmp_path / "W_S_X_CT_0004_0003_0002_02000nm.raw"
    p.write_bytes(struct.pack("<24H", *range(24)))
    d = raw.describe(p.name)
    assert d["shape"] == (2, 3, 4) and d["dtype"] == "u2"
    lines = raw.read_raw(spark, str(p), d["shape"], d["dtype"])
    vox = raw.voxels(lines)
    assert vox.where("v <> z * 12 + y * 4 + x").count() == 0 and vox.count() == 24
    assert sorted(map(tuple, raw.lines(vox).collect())) == sorted(map(tuple, lines.select("z", "y", "values").collect()))
    assert raw.slab(lines, 0, 2, 2).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1500.0, [1.0, 2.0])], "depth_mm double, img array<double>")
    sinks.write_curve_csv(df, str(tmp_path / "c"), image="img")
    rows = spark.read.csv(str(tmp_path / "c"), header=True).collect()
    assert [tuple(r) for r in rows] == [("1.500000", "1.0000"), ("1.500000", "2.0000")]
    sinks.write_table(df.select("depth_mm"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 1


def test_streams(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(windows.windowed(stream(), "ts", "1 day", ["event_type"], "value", late="4000 days"), "w1", "complete")
    assert got.agg(F.sum("n")).first()[0] == src.count()
    got = drain(windows.sessions(stream(), "ts", "2 hours", ["user_id"], "value", late="4000 days"), "s1", "complete")
    assert got.agg(F.sum("n")).first()[0] == src.count()
    got = drain(windows.job_progress(stream(), "user_id", "ts", "value"), "j1", "update")
    assert got.groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == src.count()


def test_histogram_as_curves(spark, tmp_path):
    h = spark.createDataFrame([(1.0, 1, 0.75), (1.0, 0, 0.25), (2.0, 0, 1.0), (2.0, 1, 0.0)], "depth double, bin int, y double")
    las.write_las(sinks.histogram_curves(h), str(tmp_path / "h.las"), "W")
    assert [r["HIST"] for r in las.read_las(spark, str(tmp_path / "h.las")).orderBy("depth_mm").collect()] == [[0.25, 0.75], [1.0, 0.0]]
