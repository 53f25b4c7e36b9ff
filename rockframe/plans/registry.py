"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rockframe.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (read) -> DataFrame, where read(name) scans a table, under its own name, with the SQL that checks it."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r4(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


def month(c: str) -> Column:
    return F.year(c) * 12 + F.month(c)


def day(c: str) -> Column:
    return F.unix_date(F.to_date(c))


def grid(read) -> DataFrame:
    """A sparse label map out of lineitem: order by line number, with a label and a value."""
    return read("lineitem").groupBy(F.col("l_orderkey").alias("z"), F.col("l_linenumber").alias("x")).agg((F.min("l_suppkey") % 5).alias("label"), F.avg("l_quantity").alias("v"))


def well(read) -> DataFrame:
    """A log per user out of events: depth in seconds, a curve."""
    return read("events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("depth"), "value")


def network(read) -> DataFrame:
    """Edges between suppliers and parts (as 2 s and 2 p + 1)."""
    return read("lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


GRID = "grid AS (SELECT l_orderkey AS z, l_linenumber AS x, min(l_suppkey) % 5 AS label, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
WELL = "well AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS depth, value FROM events)"
NETWORK = "network AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem)"
DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))".format
MONTH = "(year({0}) * 12 + month({0}))".format
