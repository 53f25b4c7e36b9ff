"""Proportional stratified interleaving: shards that all have the mixture of the whole.

Rows are shuffled within their source by a seeded hash; the r-th of n rows of a
source gets the fraction (r - 1/2) / n; all rows in order of their fraction are
cut in shards of equal row counts. So each shard holds each source's share, up
to rounding.

Both rankings are two-level: a row's rank is the number of rows in lower
buckets (of the hash, of the fraction) plus its rank within its own bucket.
Buckets are sized by the row count, so a source with a third of all rows is
ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.llm.ranks import ranked
from rockframe.runtime import materialize

SHARDS, SEED, BUCKET_ROWS = 40, 7, 256
LAW = "rows"


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (id, size, text_crc32, law, shard, slot, grown_shard).

    A null source is a source of its own; a null text has size 16. Rows that
    agree in id and text are interchangeable, and get different slots.
    ``grown_shard`` is null: under the law ``rows`` a further shard moves rows.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(source_col), F.lit("\0"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc", "size"))
    base = materialize(base)
    n = base.count()
    cells = 1 << max(4, min(30, (n // BUCKET_ROWS).bit_length()))
    bits = cells.bit_length() - 1
    rows = base.withColumn("hb", F.shiftrightunsigned("h", 64 - bits))
    rows = ranked(rows, ["stratum"], "hb", ["h", "id", "crc", "size"], "rank")
    strata = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    rows = rows.join(strata, "stratum").withColumn("at", (F.col("rank") + 0.5) / F.col("of"))
    rows = rows.withColumn("cell", F.least(F.floor(F.col("at") * cells), F.lit(cells - 1))).withColumn("tie", F.xxhash64("stratum", "rank"))
    rows = ranked(rows, [], "cell", ["at", "tie", "id", "crc", "size"], "g")
    shard = F.expr(f"g * {shards} div {max(n, 1)}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        F.expr(f"g - (cast(shard AS bigint) * {n} + {shards - 1}) div {shards}").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **columns: str) -> None:
    """Writes ``docs`` under ``path``, one folder per shard, in slot order. Ids must be unique here; the columns shard and slot are the plan's."""
    id_col = columns.get("id_col", "doc_id")
    plan = assign_shards(docs, **columns).select(F.col("id").alias(id_col), "shard", "slot")
    clash = [c for c in ("shard", "slot") if c in docs.columns and c != id_col]
    docs.drop(*clash).join(plan, id_col).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
