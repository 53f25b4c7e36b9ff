"""Secrets, and how widely each is copied, in SQL functions alone.

Candidates are found by pattern. Each one's hash is counted over the corpus:
in how many repositories and for how many owners it occurs. A value that many
owners hold, or a few owners in many repositories, is an example that people
copy (documentation keys, licence hashes); one that a single owner holds, in
however many repositories (forks, mirrors), is varied enough and does not read as
a placeholder looks live. Candidates of the three fixed forms stay spans in
any case and get the verdict beside; those of other forms are added only if
they look live.

Ownership counts are taken in two steps (distinct owners per value first, on
the map side too), so a value that a third of all documents hold is one small
row per owner before it meets itself. The scan writes spans without text, and
everything after works on that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.llm.spans import listed, tagged, with_matches
from rockframe.runtime import materialize

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "token", "jwt", "bearer", "url", "key_block"]
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*+[:=]\x20*+[\x22\x27]?[A-Za-z0-9+/_.=-]++"
#: The patterns.
PATTERNS = {
    "assign": (_ASSIGN, "text RLIKE '[:=]'"),
    "access": (r"AKIA[A-Z0-9]{16,}+", "instr(text, 'AKIA') > 0"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", None),
    "token": (r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|sk_live_[A-Za-z0-9]{16,}+|xox[abpr]-[A-Za-z0-9-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|npm_[A-Za-z0-9]{30,}+)", None),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "instr(text, 'eyJ') > 0"),
    "bearer": (r"(?i:bearer)\x20[A-Za-z0-9+/_.=-]{20,}+", "text RLIKE '(?i)bearer '"),
    "url": (r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{6,128}@", "instr(text, '://') > 0"),
    "key_block": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "instr(text, 'PRIVATE KEY') > 0"),
}
#: Owners from which a value counts as widely copied, and repositories from which one of two owners or more does; distinct characters below which it is too plain to be live.
COPIED_OWNERS, COPIED_REPOS, MIN_DISTINCT, MIN_ASSIGNED = 3, 8, 8, 6
PLACEHOLDER = r"(?i)(?:example|changeme|your|dummy|sample|placeholder|xxxx|redacted|0000000|1234567)"
_VALUE = r"regexp_extract(x.v, r'^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)"


def with_candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(id, owner, repo, row, cands): the spans of each row; null texts have none.

    repo and owner are hashes, null ones being one of their own. ``row`` tells
    rows that repeat an id apart; it must be written before it is used.
    """
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(0), owner_col).alias("owner"), F.xxhash64(F.lit(1), repo_col).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = {k: f"m_{k}" for k in KINDS}
    df = with_matches(df, "text", {names[k]: PATTERNS[k] for k in KINDS})
    arrays = []
    for order, kind in enumerate(KINDS):
        value = _VALUE if kind == "assign" else "x.v"
        held = f"filter({names[kind]}, x -> length({_VALUE}) >= {MIN_ASSIGNED})" if kind == "assign" else names[kind]
        plain = f"size(array_distinct(split({value}, ''))) < {MIN_DISTINCT} OR {value} RLIKE r'{PLACEHOLDER}'"
        df = df.withColumn(names[kind], F.expr(f"transform({held}, x -> struct(x.s AS s, x.e AS e, '' AS v, xxhash64({value}) AS h, {plain} AS plain))"))
        arrays.append(tagged(names[kind], kind, order, ", x.h AS h, x.plain AS plain"))
    every = F.expr(f"array_sort(concat({', '.join(arrays)}), (a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 ELSE a.k - b.k END)")
    return df.withColumn("cands", every).drop("text", *names.values()).withColumn("row", F.monotonically_increasing_id())


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, owners, repos): distinct owners and repositories of each value, over all documents."""
    each = candidates.where("size(cands) > 0").select("owner", "repo", F.explode(F.expr("array_distinct(transform(cands, x -> x.h))")).alias("h"))
    once = each.groupBy("h", "owner", "repo").agg(F.lit(1).alias("x"))
    per_owner = once.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """(id, base, spans, live): spans by place then kind, one row per row of ``docs``.

    ``live`` has, of the spans, those that look live. Without ``repo_col``,
    each document is a repository of its own.
    """
    found = materialize(with_candidates(docs, id_col, text_col, owner_col, repo_col or id_col))
    copied = materialize(ownership(found).where((F.col("owners") >= COPIED_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= COPIED_REPOS))).select("h"))
    each = found.where("size(cands) > 0").select("row", F.explode("cands").alias("c")).select("row", "c", F.col("c.h").alias("h"))
    judged = each.join(copied.withColumn("copied", F.lit(True)), "h", "left").withColumn("live", F.col("copied").isNull() & ~F.col("c.plain"))
    kept = judged.where(F.col("c.kind").isin(*BASE) | F.col("live"))
    spans = kept.groupBy("row").agg(F.collect_list(F.struct("c.s", "c.k", "c.e", "c.kind", "live")).alias("got"))
    out = found.select("id", "row").join(spans, "row", "left").withColumn("spans", F.expr("array_sort(coalesce(got, array()))"))
    return out.select("id", F.expr(f"filter(spans, x -> x.k < {len(BASE)})").alias("base"), "spans", F.expr("filter(spans, x -> x.live)").alias("live"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The digest of ``scan``."""
    out = scan(docs, id_col, text_col, owner_col)
    return out.select(
        F.col("id").alias("doc_id"),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        listed("live").alias("live_spans"),
    )
