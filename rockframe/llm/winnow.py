"""Winnowing fingerprints, in SQL functions alone.

A text is cut in pieces: a run of at most ``RUN`` code points without ASCII
white space is cut in ``PIECE`` code points each, from its start; in a longer
run (scripts without spaces, addresses, code) each code point is a piece, so
that a passage is seen there at any offset. Hashes roll over ``GRAM``
successive pieces (by doubling, so each hash is built from two shorter ones),
and of every ``WINDOW`` successive hashes the least is chosen, the rightmost of
equals. So each passage of ``GRAM + WINDOW - 1`` pieces that two texts share
leaves a common hash, and its position says where. A passage that begins or
ends inside a run is sure of its pieces from the next run on, or, inside runs
that are longer than ``RUN`` in both texts, from its first code point on.

Null texts count as empty; an empty text has no hash. A text of fewer than
``GRAM`` pieces is one gram, one of fewer than ``WINDOW`` grams one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.runtime import n_shuffle

PIECE, RUN, GRAM, WINDOW = 4, 16, 4, 8
#: Fixed value: what is not ASCII white space, as a class within a SQL string.
_SOLID = "[^\\\\x20\\\\x09-\\\\x0D]"
#: Most buckets of neighbouring ids (their bounds are part of the plan); larger buckets sort on disk.
MAX_BUCKETS = 8192
#: A chosen gram is one long: 32 bits of hash above 31 bits of (LAST - position), so that the least is the rightmost of equals.
LAST = (1 << 31) - 1


def _beside(array: str, by: int, merge: str) -> Column:
    """merge(a[i], a[i + by]) for all i that have both."""
    n = f"greatest(size({array}) - {by}, 0)"
    return F.expr(f"zip_with(slice({array}, 1, {n}), slice({array}, {by} + 1, {n}), (a, b) -> {merge})")


def pieces(text: str) -> Column:
    """The pieces of a text; one expression over the runs where some run is long, one over the text where none is."""
    cut = f"CASE WHEN char_length(w) <= {PIECE} THEN array(w) WHEN char_length(w) <= {RUN} THEN transform(sequence(1, char_length(w), {PIECE}), i -> substring(w, i, {PIECE})) ELSE split(w, '') END"
    by_run = f"flatten(transform(regexp_extract_all({text}, '{_SOLID}+', 0), w -> {cut}))"
    return F.expr(f"CASE WHEN {text} RLIKE '{_SOLID}{{{RUN + 1}}}' THEN {by_run} ELSE regexp_extract_all(coalesce({text}, ''), '{_SOLID}{{1,{PIECE}}}', 0) END")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of packed (hash, position), by ascending position. ``GRAM`` and ``WINDOW`` are powers of two."""
    t, g, p = f"_{out}_t", f"_{out}_g", f"_{out}_p"
    df = df.withColumn(t, pieces(text))
    df = df.withColumn(g, F.expr(f"transform({t}, x -> xxhash64(x))"))
    by = 1
    while by < GRAM:
        df = df.withColumn(f"{g}{by}", _beside(g, by, "xxhash64(a, b)")).drop(g).withColumnRenamed(f"{g}{by}", g)
        by *= 2
    df = df.withColumn(g, F.expr(f"CASE WHEN size({t}) >= {GRAM} THEN {g} WHEN size({t}) > 0 THEN array(xxhash64({t})) ELSE {g} END"))
    df = df.withColumn(p, F.expr(f"transform({g}, (h, i) -> shiftleft(h & 4294967295L, 31) | ({LAST}L - i))")).drop(t, g)
    df = df.withColumn(f"{p}0", F.col(p))
    by = 1
    while by < WINDOW:
        df = df.withColumn(f"{p}{by}", _beside(f"{p}0", by, "least(a, b)")).drop(f"{p}0").withColumnRenamed(f"{p}{by}", f"{p}0")
        by *= 2
    chosen = f"CASE WHEN size({p}) >= {WINDOW} THEN array_distinct({p}0) WHEN size({p}) > 0 THEN array(array_min({p})) ELSE {p} END"
    return df.withColumn(out, F.expr(chosen)).drop(p, f"{p}0")


def hashes(fingerprint: str) -> Column:
    """The set of hashes of a fingerprint."""
    return F.expr(f"array_distinct(transform({fingerprint}, x -> shiftright(x, 31)))")


def positions(fingerprint: str) -> Column:
    """The positions (numbers of pieces before the gram), in step with the packed array."""
    return F.expr(f"transform({fingerprint}, x -> cast({LAST}L - (x & {LAST}L) AS int))")


def as_text(fingerprint: str) -> Column:
    """hash:position, comma-joined, hashes in hexadecimal."""
    return F.expr(f"concat_ws(',', transform({fingerprint}, x -> concat(lower(hex(shiftright(x, 31))), ':', cast({LAST}L - (x & {LAST}L) AS string))))")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; two empty sets are alike."""
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D ELSE size(array_intersect({a}, {b})) / cast(greatest(size(array_union({a}, {b})), 1) AS double) END")


def in_order(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """(id, text, ghost, bucket): ``docs`` in buckets of neighbouring ids, each closed by its successor.

    Bucket bounds are ids of the table (approximate quantiles, one bounded
    sketch), so the first id of a bucket is known: its rows are also dealt to
    the bucket before as ghosts, the table's first to the last bucket. So every
    row finds the next one inside its own bucket, with one shuffle of the text
    and no ordering of the whole table in one task. Null ids come last.
    """
    buckets = buckets or min(4 * n_shuffle(docs.sparkSession), MAX_BUCKETS)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)]) if buckets > 1 else F.array(F.lit(0.5))
    low, cuts = src.agg(F.min("id"), F.percentile_approx("id", at, F.lit(max(10000, 10 * buckets)))).first()
    bounds = sorted({low, *(cuts or [])}) if low is not None else []
    if not bounds:
        return src.select("id", "text", F.lit(0).alias("ghost"), F.lit(0).alias("bucket"))
    known, n = F.array(*[F.lit(int(x)).cast("bigint") for x in bounds]), len(bounds)
    placed = src.withColumn("bucket", F.when(F.col("id").isNull(), n - 1).otherwise(F.size(F.filter(known, lambda b: b <= F.col("id"))) - 1))
    twice = F.element_at(known, F.col("bucket") + 1) == F.col("id")
    own, ghost = F.struct("bucket", F.lit(0).alias("ghost")), F.struct(F.when(F.col("bucket") == 0, n - 1).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("ghost"))
    return placed.withColumn("to", F.explode(F.when(twice, F.array(own, ghost)).otherwise(F.array(own)))).select("id", "text", "to.ghost", "to.bucket")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, fp, edited_fp, next_fp): fingerprints of each text, of its half-replaced form and of the next text.

    Rows that repeat an id follow each other by text.
    """
    w = Window.partitionBy("bucket").orderBy("ghost", F.asc_nulls_last("id"), "text")
    df = in_order(docs, id_col, text_col).withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    df = with_fingerprint(df, "text", "fp")
    df = df.withColumn("next_fp", F.coalesce(F.lead("fp").over(w), F.array().cast("array<bigint>"))).where("ghost = 0")
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next, 1, n_chars div 2))"))
    return with_fingerprint(df, "edited", "edited_fp").drop("next", "ghost", "bucket")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``with_edited``, one row per row of ``docs``."""
    df = with_edited(docs, id_col, text_col)
    for name in ("fp", "edited_fp", "next_fp"):
        df = df.withColumn(f"{name}_set", hashes(name))
    return df.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp_set", "edited_fp_set").alias("near_edited"),
        likeness("fp_set", "next_fp_set").alias("near_next"),
    )
