"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each document has a vector of transformed statistics. For each group (language
and source, language, all) the minimum-covariance-determinant estimate is
found by concentration: under an estimate the distances of all the group's
documents are taken, and the mean and covariance of the nearest ``CORE`` share
are the next estimate, whose determinant is never larger. That is done from
four deterministic starts (quartiles; mean and covariance; signs; squashed
values) until no determinant falls any more, and the start that ends with the
least is kept. Every statistic is granted a small spread of its own
(``FLOOR``), so a determinant is never zero. A group's estimate is then drawn
towards its language's, and that towards the estimate of all, as if ``DRAW``
documents of the wider group had been seen: groups of any size have an
estimate, small ones mostly that of their language. Documents whose
Mahalanobis distance passes the limit are rejected.

A step sorts nothing and gathers no group: distances fall in bins of an eighth
octave, moments are summed per group, start and bin before any shuffle, and
the core is the bins up to the one in which the share is reached, of which it
takes the fraction that is left. An estimate reads one row per bin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rockframe.runtime import bounded_batches, materialize

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_letters"]
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Share of a group's documents in the core; documents of the wider group that each estimate is drawn by; most concentration steps, and the fall of a determinant's logarithm that still counts.
CORE, DRAW, STEPS, SETTLED = 0.75, 100.0, 12, 1e-3
#: Distances squared above this are outliers (one in 60 000 of a normal distribution in six dimensions), and the spread that every statistic is granted.
LIMIT = 32.0
FEATURES = ["x_length", "x_symbols", "x_dup", "x_repeat", "x_upper", "x_digits"]
FLOOR = [0.03, 0.02, 0.12, 0.12, 0.03, 0.1]
#: Words' worth of the corpus' average that each document's rates are pulled by: few words tell little.
PRIOR = 60.0
LOW_BIN, HIGH_BIN = -80, 160
#: Covariance of a normal core of three quarters in six dimensions, to full covariance: 0.75 / P(chi2 of 8 < the 0.75 quantile of chi2 of 6).
CONSISTENCY = 1.36

_upper = re.compile("[A-ZÀ-ÖØ-Þ]").findall


def text_counts(text: str | None) -> tuple[int, ...]:
    """Counts of one text, in the order of BASE and MORE. Null counts as no text."""
    text = text or ""
    words = text.encode().split()  # \x20 and \x09-\x0D
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.encode().split())
    n_lines = sum(lines.values())
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
            covered[at] += 1
            np.subtract.at(covered, at + WINDOW, 1)
            repeat = int((np.cumsum(covered)[:n] > 0).sum())
    letters = sum(map(str.isalpha, text)) if n < 5 else len(text) - spaces - symbols
    return n, len(text) - spaces, symbols, n_lines - len(lines), repeat, n_lines, len(_upper(text)), sum(map(text.count, "0123456789")), letters


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the counts of each text, renamed so that nothing clashes: k0, k1 ... and the counts."""
    keep = keep or []
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([text_counts(t.as_py()) for t in b.column(0)], np.int64).reshape(-1, len(BASE) + len(MORE))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c) for c in rows.T]], names=[*b.schema.names[1:], *BASE, *MORE])

    return src.mapInArrow(run, kinds + ", ".join(f"{c} bigint" for c in BASE + MORE))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def features(stats: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Adds the transformed statistics: the log of a word's mean length, and angles of rates (their variance hardly depends on the rate).

    ``rates`` has the corpus' averages, to which few words are pulled.
    """
    n = F.col("n_words") + PRIOR

    def angle(count: str, per: Column, rate: float, weight: float) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(count) + rate * weight) / (per + weight))))

    chars = PRIOR * rates["length"]
    return (
        stats.withColumn("x_length", F.log((F.col("word_chars") + chars) / n))
        .withColumn("x_symbols", angle("n_symbols", F.col("word_chars"), rates["symbols"], chars))
        .withColumn("x_dup", angle("n_dup_lines", F.col("n_lines"), rates["dup"], 4.0))
        .withColumn("x_repeat", angle("n_repeat_words", F.col("n_words"), rates["repeat"], PRIOR))
        .withColumn("x_upper", angle("n_upper", F.col("word_chars"), rates["upper"], chars))
        .withColumn("x_digits", angle("n_digits", F.col("word_chars"), rates["digits"], chars))
    )


def corpus_rates(stats: DataFrame) -> dict[str, float]:
    """Averages over all documents that pass the fixed limits: one row of sums."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]
    s = stats.where(~base_failed()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    of = lambda a, b: s[a] / max(s[b], 1)
    return {"length": of("word_chars", "n_words") or 1.0, "symbols": of("n_symbols", "word_chars"), "dup": of("n_dup_lines", "n_lines"), "repeat": of("n_repeat_words", "n_words"), "upper": of("n_upper", "word_chars"), "digits": of("n_digits", "word_chars")}


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance() -> Column:
    """Squared Mahalanobis distance under the columns mu and prec (upper triangle, doubled off the diagonal)."""
    d = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    return sum((F.col("prec")[k] * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _upper_of(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in _PAIRS]


def _full(upper: list[float]) -> np.ndarray:
    m = np.zeros((len(FEATURES), len(FEATURES)))
    for (i, j), v in zip(_PAIRS, upper, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of sums [n, sums, sums of products]; rounding may leave tiny negative spreads, which go."""
    f = len(FEATURES)
    mean = s[1 : f + 1] / s[0]
    values, vectors = np.linalg.eigh(_full(s[f + 1 :]) / s[0] - np.outer(mean, mean))
    return mean, (vectors * np.maximum(values, 0)) @ vectors.T


def _granted(cov: np.ndarray) -> np.ndarray:
    return cov * CONSISTENCY + np.diag(np.square(FLOOR))


def estimate(n: float, mean: np.ndarray, cov: np.ndarray) -> dict:
    """A row of a model; ``cov`` is a full covariance with its granted spread."""
    p = np.linalg.inv(cov)
    prec = [float(p[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]
    return {"n": float(n), "mu": mean.tolist(), "cov": _upper_of(cov), "prec": prec, "logdet": float(np.linalg.slogdet(cov)[1])}


def from_bins(bins: list[list[float]]) -> dict:
    """The next estimate from a group's sums per distance bin: [bin, n, sums, sums of products]. The last bin of the core counts in part."""
    rows = np.array(sorted(bins))
    n = rows[:, 1]
    share = np.clip((max(1.0, CORE * n.sum()) - (n.cumsum() - n)) / n, 0, 1)
    mean, cov = _moments((rows[:, 1:] * share[:, None]).sum(0))
    return estimate(n.sum(), mean, _granted(cov))


def starts(values: list[list[float]]) -> list[dict]:
    """Four estimates of a group from its quartiles, moments, and the moments of its signs and squashed values."""
    quartiles, raw, signs, squashed = (np.array(v, float) for v in values)
    q = quartiles.reshape(len(FEATURES), 3)
    mid, scale = q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)
    out = [estimate(raw[0], mid, _granted(np.diag(scale**2))), estimate(raw[0], *(lambda m, c: (m, _granted(c)))(*_moments(raw)))]
    for s in (signs, squashed):
        cov = _moments(s)[1]
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out.append(estimate(raw[0], mid, _granted(cov / np.outer(spread, spread) * np.outer(scale, scale))))
    return out


def _rows_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_NUMBERS = pa.list_(pa.float64())
_MODEL_ARROW = pa.schema([("g", pa.int64()), ("s", pa.int32()), ("n", pa.float64()), ("mu", _NUMBERS), ("cov", _NUMBERS), ("prec", _NUMBERS), ("logdet", pa.float64())])
MODEL = "g bigint, s int, n double, mu array<double>, cov array<double>, prec array<double>, logdet double"


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(g, i, *e.values()) for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, e in enumerate(starts(v))]
        yield _rows_of(found, _MODEL_ARROW)


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g, s, bins = (c.to_pylist() for c in b.columns)
        yield _rows_of([(x, y, *from_bins(v).values()) for x, y, v in zip(g, s, bins, strict=True)], _MODEL_ARROW)


def drawn(own: dict, wider: dict, draw: float = DRAW) -> dict:
    """An estimate drawn towards that of a wider group: moments of n documents of the one and ``draw`` of the other."""
    n = own["n"]
    a, b = n / (n + draw), draw / (n + draw)
    mu, far = np.array(own["mu"]) * a + np.array(wider["mu"]) * b, np.array(own["mu"]) - np.array(wider["mu"])
    return estimate(n, mu, _full(own["cov"]) * a + _full(wider["cov"]) * b + a * b * np.outer(far, far))


def _drawn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fine, own, language, all) to the final estimate of each group of language and source; parts without an estimate are null."""
    schema = pa.schema([("fine", pa.int64()), ("mu", _NUMBERS), ("prec", _NUMBERS)])
    for b in batches:
        found = []
        for g, own, lang, every in zip(*(c.to_pylist() for c in b.columns), strict=True):
            best = every
            for e in (lang, own):
                best = e if best is None else best if e is None else drawn(e, best)
            found.append((g, best and best["mu"], best and best["prec"]))
        yield _rows_of(found, schema)


def _fine(lang: str, source: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(lang), F.col(source))


def _coarse(lang: str) -> Column:
    return F.xxhash64(F.lit(2), F.col(lang))


def fit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[str], steps: int = STEPS) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(rows, models, rates): counts and features of each row with its group (fine), written without text; one estimate per group.

    Nulls of language and source are values of their own.
    """
    stats = materialize(with_counts(docs, text_col, [*keep, lang_col, source_col]))
    lang, source = f"k{len(keep)}", f"k{len(keep) + 1}"
    rates = corpus_rates(stats)
    rows = materialize(features(stats, rates).withColumn("fine", _fine(lang, source)).withColumn("coarse", _coarse(lang)))
    good = rows.where(~base_failed()).select(*FEATURES, F.explode(F.array("fine", "coarse", F.lit(0).cast("bigint"))).alias("g"))

    def sums(cols: list[Column]) -> list[Column]:
        return [F.count(F.lit(1)).cast("double"), *[F.sum(c) for c in cols], *[F.sum(cols[i] * cols[j]) for i, j in _PAIRS]]

    quartiles = materialize(good.groupBy("g").agg(F.flatten(F.array(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000) for x in FEATURES])).alias("q")))
    z = [(F.col(x) - F.col("q")[3 * i + 1]) / F.greatest((F.col("q")[3 * i + 2] - F.col("q")[3 * i]) / 1.349, F.lit(FLOOR[i])) for i, x in enumerate(FEATURES)]
    size = F.sqrt(sum((c * c for c in z), F.lit(1e-9)))
    wide = good.join(quartiles, "g").select("g", "q", *FEATURES, *[c.alias(f"z{i}") for i, c in enumerate(z)], size.alias("zs"))
    at = [F.col(f"z{i}") for i in range(len(FEATURES))]
    parts = [sums([F.col(x) for x in FEATURES]), sums([c / F.col("zs") for c in at]), sums([F.tanh(c) for c in at])]
    begun = wide.groupBy("g", "q").agg(*[F.array(*p).alias(f"m{i}") for i, p in enumerate(parts)])
    model = materialize(begun.select("g", F.array("q", "m0", "m1", "m2").alias("values")).mapInArrow(_started, MODEL))
    moving = model
    for _ in range(steps):
        near = moving.select("g", "s", "mu", "prec")
        far = good.join(near, "g").withColumn("bin", F.greatest(F.lit(LOW_BIN), F.least(F.lit(HIGH_BIN), F.floor(8 * F.log2(_distance() + 1e-9)))).cast("int"))
        bins = far.groupBy("g", "s", "bin").agg(F.array(F.col("bin").cast("double"), *sums([F.col(x) for x in FEATURES])).alias("row"))
        after = materialize(bins.groupBy("g", "s").agg(F.collect_list("row").alias("values")).mapInArrow(_stepped, MODEL))
        # The first step goes from a start to a core; from then on a determinant that does not fall is settled.
        fell = after.join(moving.select("g", "s", F.col("logdet").alias("was")), ["g", "s"])
        if moving is model:
            best, moving = after, after
        else:
            best = materialize(best.union(after).groupBy("g", "s").agg(F.min_by(F.struct(*[c for c in after.columns if c not in ("g", "s")]), "logdet").alias("x")).select("g", "s", "x.*"))
            moving = materialize(fell.where(F.col("was") - F.col("logdet") > SETTLED).drop("was"))
            if not moving.limit(1).count():
                break
    least = best.groupBy("g").agg(F.min_by(F.struct("n", "mu", "cov"), F.struct("logdet", "s")).alias("e"))
    least = materialize(least)
    groups = rows.select("fine", "coarse").distinct()
    of = lambda name: least.select(F.col("g").alias(name), F.col("e").alias(f"{name}_e"))
    joined = groups.join(of("fine"), "fine", "left").join(of("coarse"), "coarse", "left").join(of("every"), F.col("every") == 0, "left")
    return rows, materialize(joined.select("fine", "fine_e", "coarse_e", "every_e").mapInArrow(_drawn_rows, "fine bigint, mu array<double>, prec array<double>")), rates


def _verdicts(rows: DataFrame, limit: float) -> DataFrame:
    """Adds distance, base_failed and kept to rows that have mu and prec (null where no estimate is comparable: those are kept)."""
    out = rows.withColumn("distance", F.when(F.col("mu").isNotNull(), _distance())).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """``keep`` (as k0, k1 ...), counts, distance, base_failed and kept, one row per row of ``docs``.

    Documents that fail the fixed limits take no part in an estimate. Null and
    empty texts, and those of white space alone, have no word and fail them;
    very long texts are counted whole. Where no document passes the fixed
    limits there is no estimate, and nothing else is rejected.
    """
    keep = keep or []
    rows, model, _ = fit(docs, text_col, lang_col, source_col, keep, steps)
    out = _verdicts(rows.join(model, "fine", "left"), limit)
    return out.select(*[f"k{i}" for i in range(len(keep))], *BASE, *FEATURES, "distance", "base_failed", "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Estimates are fitted from counts alone; a second pass over the texts counts
    again and meets the estimates on the group, so no text is shuffled and none
    comes back from a Python worker.
    """
    rows, groups, rates = fit(docs, text_col, lang_col, source_col, [], steps)
    own = docs.columns
    kind = "struct<" + ", ".join(f"{c}:bigint" for c in BASE + MORE) + ">"

    @F.arrow_udf(kind)
    def counts(texts: pa.Array) -> pa.Array:
        got = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(BASE) + len(MORE))
        return pa.StructArray.from_arrays([pa.array(c) for c in got.T], names=BASE + MORE)

    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(own)])
    at = {c: f"k{i}" for i, c in enumerate(own)}
    # Called non-deterministic so that the planner evaluates it once per row, not once per use.
    counted = src.withColumn("_c", counts.asNondeterministic()(F.col(at[text_col])))
    wide = features(counted.select(*at.values(), *[F.col("_c")[c].alias(c) for c in BASE + MORE]), rates).withColumn("fine", _fine(at[lang_col], at[source_col]))
    kept = _verdicts(wide.join(groups, "fine", "left"), limit).where("kept")
    return kept.select(*[F.col(k).alias(c) for c, k in at.items()])
