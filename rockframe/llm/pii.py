"""Personal data by weak supervision, in SQL functions and a bounded table of counts.

Patterns propose spans. Labelers vote on each (1 personal, -1 not, 0 no
opinion): the form's own checks, gazetteers, the words around, and the shape of
the digits. How far each labeler can be trusted is not known; it is estimated
by expectation-maximisation from how they agree, with one reliability per
labeler and side and one prior per kind. Votes are few and discrete, so the
corpus enters as counts of vote patterns (at most kinds x 3^4 x shapes rows,
one aggregate, the only thing that reaches the driver) and the estimate covers
every span of every document. The posteriors then train the final classifier, a
naive Bayes model over kind, context and shape, which decides what is added.
Spans of the four fixed forms stay whatever it says.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.llm.spans import listed, tagged, with_matches
from rockframe.runtime import materialize

KINDS = ["email", "ip", "card", "phone", "obscured", "local_phone", "ssn", "iban", "person"]
BASE = KINDS[:4]
_LOCAL = "A-Za-z0-9._%+-"
#: The patterns. Possessive quantifiers and the guards before runs change no match, only the time of failing.
PATTERNS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0"),
    "ip": (r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0"),
    "obscured": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?(?:\[at\]|\(at\)|\{{at\}})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{{dot\}})\x20?)[A-Za-z0-9-]++)++", "text LIKE '%at%'"),
    "local_phone": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "instr(text, '-') > 0"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "person": (r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?(?![\p{L}])", None),
}
#: Gazetteers.
GIVEN_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Sarah Karen Peter Hans Anna Maria Jean Marie Pierre Claire José Carmen Luis Sofia Juan".split()
DOMAINS = "com org net edu gov io co uk de fr es it nl eu info".split()
CONTEXT = r"(?i)(?:e-?mail|mailto|contact|phone|tel|call|fax|mobile|cell|card|visa|mastercard|credit|account|iban|ssn|social security|ip|address|host|server|name|dear|from|to|kontakt|telefon|adresse|correo|tarjeta|courriel|carte)[:.#\x20]{0,3}$"
AGAINST = r"(?i)(?:version|v|section|chapter|isbn|issn|doi|page|figure|table|no|sku|build)[:.#\x20]{0,3}$"
#: Code points of context on either side; share of certainty from which a span is added; rounds.
NEAR, ADD_AT, ROUNDS = 24, 0.9, 50
LABELERS = ["v_form", "v_gazetteer", "v_context", "v_digits"]


def _luhn(digits: str) -> str:
    d = f"cast(substring({digits}, i, 1) AS int)"
    twice = f"CASE WHEN (length({digits}) - i) % 2 = 1 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + {twice}) % 10 = 0"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Which matches of the fixed forms hold.
HOLDS = {
    "email": "true",
    "ip": rf"x.v RLIKE r'^{_PART}(?:\.{_PART}){{3}}$'",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def _iban_valid() -> str:
    """The check number of an account: its letters as numbers, rotated by four, modulo 97."""
    flat = "replace(x.v, ' ', '')"
    turned = f"concat(substring({flat}, 5), substring({flat}, 1, 4))"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN cast(c AS int) ELSE ascii(c) - 55 END"
    return f"aggregate(split({turned}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a ELSE (a * CASE WHEN c BETWEEN '0' AND '9' THEN 10 ELSE 100 END + {value}) % 97 END) = 1"


def _votes(kind: str) -> dict[str, str]:
    """SQL of each labeler's vote on a span x with the text before (x.b)."""
    names, domains = "|".join(GIVEN_NAMES), "|".join(DOMAINS)
    form = {"ssn": "CASE WHEN x.v RLIKE r'^(?:000|666|9[0-9]{2})-|-00-|-0000$' THEN -1 ELSE 1 END", "iban": f"CASE WHEN {_iban_valid()} THEN 1 ELSE -1 END", "local_phone": r"CASE WHEN x.v RLIKE r'^\(?[2-9]' THEN 1 ELSE -1 END", "person": "0"}
    gazetteer = {
        "email": rf"CASE WHEN x.v RLIKE r'\.(?:{domains})$' THEN 1 ELSE 0 END",
        "obscured": rf"CASE WHEN x.v RLIKE r'(?:{domains})$' THEN 1 ELSE -1 END",
        "ip": r"CASE WHEN x.v RLIKE r'^(?:0|127|255)\.' THEN -1 ELSE 0 END",
        "card": "CASE WHEN x.v RLIKE '^[3-6]' THEN 1 ELSE -1 END",
        "person": f"CASE WHEN x.v RLIKE '(?:{names})' THEN 1 ELSE -1 END",
    }
    return {
        "v_form": form.get(kind, "1"),
        "v_gazetteer": gazetteer.get(kind, "0"),
        "v_context": f"CASE WHEN x.b RLIKE r'{CONTEXT}' THEN 1 WHEN x.b RLIKE r'{AGAINST}' THEN -1 ELSE 0 END",
        "v_digits": "0" if kind in ("email", "obscured", "person") else "CASE WHEN x.v RLIKE r'^[^0-9]*([0-9])(?:[^0-9]*\\1)*[^0-9]*$' THEN -1 ELSE 1 END",
    }


def with_candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` as k0, k1 ..., text, and cands: array of (k, s, e, kind, v, base, votes), by kind and place."""
    keep = keep or []
    df = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = {k: f"m_{k}" for k in KINDS}
    df = with_matches(df, "text", {names[k]: PATTERNS[k] for k in KINDS})
    arrays = []
    for order, kind in enumerate(KINDS):
        held = f"filter({names[kind]}, x -> {HOLDS[kind]})" if kind in HOLDS else names[kind]
        seen = f"transform({held}, x -> struct(x.s AS s, x.e AS e, x.v AS v, substring(text, greatest(x.s - {NEAR - 1}, 1), least(x.s, {NEAR})) AS b))"
        votes = ", ".join(f"cast({v} AS int) AS {n}" for n, v in _votes(kind).items())
        df = df.withColumn(names[kind], F.expr(seen))
        arrays.append(tagged(names[kind], kind, order, f", {'true' if kind in BASE else 'false'} AS base, {votes}, cast(least(x.e - x.s, 40) div 8 AS int) AS shape"))
    return df.withColumn("cands", F.expr(f"concat({', '.join(arrays)})")).drop(*names.values())


def vote_counts(candidates: DataFrame) -> list[tuple]:
    """(kind, votes ..., shape, n) over the corpus: a bounded number of rows."""
    rows = candidates.where("size(cands) > 0").select(F.explode("cands").alias("c"))
    return [tuple(r) for r in rows.groupBy("c.kind", *[f"c.{v}" for v in LABELERS], "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()]


def reliabilities(counts: list[tuple]) -> tuple[dict[str, float], dict[tuple[str, int, int], float]]:
    """Expectation-maximisation over vote patterns: the prior of each kind, and P(vote | truth) of each labeler.

    Starts from labelers that are right three times in four; pseudo-counts keep
    every probability inside (0, 1). Without any span the start is returned.
    """
    prior = {k: 0.7 for k in KINDS}
    like = {(name, v, y): (0.5 if v == 0 else 0.375 if (v > 0) == bool(y) else 0.125) for name in LABELERS for v in (-1, 0, 1) for y in (0, 1)}
    for _ in range(ROUNDS if counts else 0):
        seen = {k: [0.7 * 4, 4.0] for k in KINDS}
        got = {key: 8 * p for key, p in zip(like, [0.5 if v == 0 else 0.375 if (v > 0) == bool(y) else 0.125 for _, v, y in like], strict=True)}
        for kind, *votes, _, n in counts:
            p = posterior(kind, votes, prior, like)
            seen[kind][0] += n * p
            seen[kind][1] += n
            for name, v in zip(LABELERS, votes, strict=True):
                got[name, v, 1] += n * p
                got[name, v, 0] += n * (1 - p)
        prior = {k: a / b for k, (a, b) in seen.items()}
        like = {(name, v, y): got[name, v, y] / sum(got[name, u, y] for u in (-1, 0, 1)) for name, v, y in like}
    return prior, like


def posterior(kind: str, votes: list[int], prior: dict, like: dict) -> float:
    z = math.log(prior[kind]) - math.log(1 - prior[kind]) if 0 < prior[kind] < 1 else (30.0 if prior[kind] else -30.0)
    for name, v in zip(LABELERS, votes, strict=True):
        z += math.log(like[name, v, 1]) - math.log(like[name, v, 0])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(candidates: DataFrame) -> dict[str, float]:
    """The final classifier, as P(personal) of each cell 'kind|votes|shape' that occurs.

    A naive Bayes model over the cell's parts, trained on the soft labels.
    """
    counts = vote_counts(candidates)
    prior, like = reliabilities(counts)
    part: dict[tuple, list[float]] = {}
    total = [2.0, 2.0]
    for kind, *votes, shape, n in counts:
        p = posterior(kind, votes, prior, like)
        for y, w in ((1, n * p), (0, n * (1 - p))):
            total[y] += w
            for f in (("kind", kind), ("shape", kind, shape), *zip(LABELERS, [kind] * 4, votes, strict=True)):
                part.setdefault(f, [0.5, 0.5])[y] += w
    model = {}
    for kind, *votes, shape, _ in counts:
        k = part["kind", kind]
        z = math.log(k[1] / k[0])
        for f in (("shape", kind, shape), *zip(LABELERS, [kind] * 4, votes, strict=True)):
            z += math.log(part[f][1] / k[1]) - math.log(part[f][0] / k[0])
        model["|".join(map(str, (kind, *votes, shape)))] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return model


def with_spans(candidates: DataFrame, model: dict[str, float]) -> DataFrame:
    """Adds base and spans: the spans of the fixed forms, and those with what the classifier adds, by kind and place."""
    df = candidates.withColumn("base", F.expr("filter(cands, x -> x.base)"))
    added = [c for c, p in model.items() if p >= ADD_AT]
    if not added:
        return df.withColumn("spans", F.col("base"))
    cell = "concat_ws('|', x.kind, " + ", ".join(f"cast(x.{v} AS string)" for v in LABELERS) + ", cast(x.shape AS string))"
    within = "exists(base, y -> y.s < x.e AND x.s < y.e)"
    cells = ", ".join(f"'{c}'" for c in sorted(added))
    return df.withColumn("spans", F.expr(f"filter(cands, x -> x.base OR (array_contains(array({cells}), {cell}) AND NOT {within}))"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and places of personal data, one row per row of ``docs``; null texts count as empty.

    The spans of a document are found once and written without its text; the
    estimate and the result both read that table.
    """
    found = materialize(with_candidates(docs, text_col, [id_col]).drop("text"))
    out = with_spans(found, fit(found))
    return out.select(
        F.col("k0").alias("doc_id"),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets (overlapping ones by the first); n_chars follows where there is such a column."""
    own = docs.columns
    found = with_candidates(docs, text_col, own)
    out = with_spans(found, fit(found.select("cands")))
    step = "CASE WHEN x.e <= a.p THEN a WHEN x.s < a.p THEN struct(x.e AS p, a.o AS o) ELSE struct(x.e AS p, concat(a.o, substring(text, cast(a.p + 1 AS int), cast(x.s - a.p AS int)), '[', upper(x.kind), ']') AS o) END"
    start = "cast(struct(0L AS p, '' AS o) AS struct<p:bigint,o:string>)"
    clean = f"CASE WHEN size(spans) = 0 THEN text ELSE aggregate(array_sort(transform(spans, x -> struct(x.s AS s, x.e AS e, x.kind AS kind))), {start}, (a, x) -> cast({step} AS struct<p:bigint,o:string>), a -> concat(a.o, substring(text, cast(a.p + 1 AS int)))) END"
    out = out.withColumn("clean", F.expr(clean))
    given = {c: F.col(f"k{i}") for i, c in enumerate(own)}
    text = F.when(given[text_col].isNotNull(), F.col("clean")).alias(text_col)
    size = F.when(F.expr("size(spans) > 0"), F.char_length("clean").cast("bigint"))
    return out.select(*[text if c == text_col else F.coalesce(size, x).alias(c) if c == "n_chars" else x.alias(c) for c, x in given.items()])
