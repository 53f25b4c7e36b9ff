"""Spans of pattern matches, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<s:bigint,e:bigint,v:string>"
#: Matches whose places are added up in one list; lists are joined at the end, so a text with very many matches costs no square.
BLOCK = 256


def literal(pattern: str) -> str:
    """A regular expression as a raw SQL string; quotes in it must be written as \\x27 and \\x22."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Adds, for each name, the array of (s, e, v) of all leftmost non-overlapping matches in ``text``.

    s and e count code points, e is exclusive, v is the match. ``patterns`` has
    a regular expression and, to save its search, a SQL condition without which
    there is no match. A match's place is the length of what splitting by the
    same expression leaves before it.
    """
    for name, (pattern, gate) in patterns.items():
        p = literal(pattern)
        hit = f"({gate}) AND {text} RLIKE {p}" if gate else f"{text} RLIKE {p}"
        df = df.withColumn(f"_{name}", F.expr(f"CASE WHEN {hit} THEN arrays_zip(split({text}, {p}, -1) AS g, regexp_extract_all({text}, {p}, 0) AS m) END".replace(" AS g,", ",").replace(" AS m)", ")")))
        df = df.withColumn(f"_{name}", F.expr(f"filter(transform(_{name}, x -> struct(char_length(x['0']) AS g, x['1'] AS m)), x -> x.m IS NOT NULL)"))
        state = f"struct<p:bigint,o:array<{SPAN}>>"
        step = f"cast(struct(a.p + x.g + char_length(x.m) AS p, concat(a.o, array(struct(a.p + x.g AS s, a.p + x.g + char_length(x.m) AS e, x.m AS v))) AS o) AS {state})"
        inside = f"aggregate(block, cast(struct(t.last.p AS p, array() AS o) AS {state}), (a, x) -> {step})"
        blocks = f"transform(sequence(0, (size(_{name}) - 1) div {BLOCK}), i -> slice(_{name}, i * {BLOCK} + 1, {BLOCK}))"
        whole = f"struct<last:{state},done:array<array<{SPAN}>>>"
        walk = f"CASE WHEN size(_{name}) > 0 THEN aggregate({blocks}, cast(struct(struct(0L AS p, array() AS o) AS last, array() AS done) AS {whole}), (t, block) -> cast(struct({inside} AS last, concat(t.done, array(t.last.o)) AS done) AS {whole}), t -> flatten(concat(t.done, array(t.last.o)))) END"
        df = df.withColumn(name, F.expr(f"coalesce({walk}, cast(array() AS array<{SPAN}>))")).drop(f"_{name}")
    return df


def tagged(column: str, kind: str, order: int, extra: str = "") -> str:
    """SQL: the spans of a column with their kind and its rank."""
    return f"transform({column}, x -> struct({order} AS k, x.s AS s, x.e AS e, '{kind}' AS kind, x.v AS v{extra}))"


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat_ws(':', x.kind, cast(x.s AS string), cast(x.e AS string))))")
