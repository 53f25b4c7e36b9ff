"""Language identification, words first.

A known word adds its log frequency in each language. An unseen word is scored
by its longest character n-grams of which any is known, else by shorter ones.
The language with the highest mean wins; the score is its posterior under a
tempered likelihood (words of one text are far from independent).

The model is fitted on a bounded, seeded sample of labelled texts (``fit_rows``
documents) and keeps at most ``words`` words and ``grams`` n-grams of each
length per language, so its size has a bound and it can be broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.runtime import bounded_batches

FIT_ROWS, WORDS, GRAMS, ORDERS = 3000, 20000, 6000, (5, 4, 3, 2, 1)
#: A word counts as known if so many fitted texts' worth of it was seen.
MIN_COUNT, CACHE_WORDS, SLICE, UND = 3, 100_000, 65536, "und"
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _words((text or "").lower())
    return found if all(map(str.isalpha, found[:1])) else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _slices(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams of a word, SLICE at most at a time."""
    w = f"^{word}$" if n > 1 else word
    for at in range(0, len(w) - n + 1, SLICE):
        part = w[at : at + SLICE + n - 1]
        yield [part[i : i + n] for i in range(len(part) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, unit, count) of a partition; n = 0 for words. N-grams count once per distinct word and text."""
    for b in batches:
        seen: Counter = Counter()
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            lang, own = lang.as_py(), Counter(words_of(text.as_py()))
            seen.update({(lang, 0, w): c for w, c in own.items()})
            for w in own:
                for n in ORDERS:
                    seen.update((lang, n, g) for g in grams_of(w, n))
        rows = [(*k, c) for k, c in seen.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["lang", "n", "unit", "c"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS) -> dict:
    """The model: languages, and for each unit its log frequencies. Rows without a language or text are left out.

    The sample keeps the rows whose text hashes under a threshold, about
    ``fit_rows`` of them; counting runs on the executors, and only the kept
    units come to the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    total = rows.count()
    if not total:
        return {"langs": [], "units": {}}
    share = min(1.0, fit_rows / total)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(11), "t"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = sample.mapInArrow(_counts, "lang string, n int, unit string, c bigint").groupBy("lang", "n", "unit").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "unit")
    every = Window.partitionBy("lang", "n")
    top = counts.withColumn("all", F.sum("c").over(every)).withColumn("r", F.row_number().over(order))
    top = top.where((F.col("r") <= F.when(F.col("n") == 0, words).otherwise(grams)) & (F.col("c") >= MIN_COUNT))
    kept = top.select("lang", "n", "unit", "c", "all").toPandas()
    langs = sorted(kept["lang"].unique())
    if not langs:
        return {"langs": [], "units": {}}
    at = {x: i for i, x in enumerate(langs)}
    mass = np.ones((max(ORDERS) + 1, len(langs)))
    for lang, n, _, _, total in kept.drop_duplicates(["lang", "n"]).itertuples(index=False):
        mass[n, at[lang]] = total
    raw: dict[tuple[int, str], np.ndarray] = {}
    for lang, n, unit, c, _ in kept.itertuples(index=False):
        raw.setdefault((n, unit), np.zeros(len(langs)))[at[lang]] = c
    units = {k: np.log((v + 0.5) / (mass[k[0]] + 0.5 * len(raw))).astype(np.float32) for k, v in raw.items()}
    return {"langs": langs, "units": units}


def compact(model: dict) -> dict:
    """The model as workers get it: units in one list for each length, and one matrix of frequencies centred over the languages."""
    names = {k: [u for n, u in model["units"] if n == k] for k in (0, *ORDERS)}
    freq = [v - np.mean(v) for v in (model["units"][k, u] for k, own in names.items() for u in own)]
    return {"langs": model["langs"], "names": names, "freq": np.array(freq, np.float32).reshape(len(freq), max(1, len(model["langs"])))}


class Scorer:
    """Scores texts under a model or its compact form; one per worker."""

    def __init__(self, model: dict):
        model = model if "names" in model else compact(model)
        self.langs, self.freq = model["langs"], model["freq"]
        self.rows: dict[int, dict[str, int]] = {}
        at = 0
        for n, own in model["names"].items():
            self.rows[n] = dict(zip(own, range(at, at + len(own)), strict=True))
            at += len(own)
        self.row: dict[str, int] = {}
        self.table = np.zeros((CACHE_WORDS, max(1, len(self.langs))), np.float32)

    def word(self, w: str) -> np.ndarray:
        """Log frequencies of one word, centred over the languages."""
        i = self.rows[0].get(w)
        if i is not None:
            return self.freq[i]
        for n in ORDERS:
            find = self.rows[n].get
            total, seen = 0.0, 0
            for part in _slices(w, n):
                if hits := [i for g in part if (i := find(g)) is not None]:
                    total, seen = total + self.freq[hits].sum(0, dtype=np.float64), seen + len(hits)
            if seen:
                return (total / seen).astype(np.float32)
        return np.zeros(max(1, len(self.langs)), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = Counter(words_of(text))
        if not own or not self.langs:
            return UND, 0.0
        if len(self.row) + len(own) > CACHE_WORDS:
            self.row.clear()
        total = np.zeros(len(self.langs))
        row, at, n = self.row, [], []
        for w, c in own.items():
            i = row.get(w)
            if i is None:
                if len(row) >= CACHE_WORDS:  # a text with more words than the table holds
                    total += c * self.word(w)
                    continue
                i = row[w] = len(row)
                self.table[i] = self.word(w)
            at.append(i)
            n.append(c)
        total += np.asarray(n, np.float64) @ self.table[at]
        size = sum(own.values())
        z = total / math.sqrt(size)
        z = np.exp(z - z.max())
        best = int(z.argmax())
        return self.langs[best], float(z[best] / z.sum())


#: A worker drops a broadcast, and with it the scorer, once a task comes that doesn't use it.
_scorers: WeakKeyDictionary[Broadcast, Scorer] = WeakKeyDictionary()


def _scorer(shared: Broadcast) -> Scorer:
    """One scorer, and one memory of words, per model and worker process."""
    if shared not in _scorers:
        _scorers[shared] = Scorer(shared.value)
    return _scorers[shared]


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (as k0, k1 ...), lang_pred and score; ``und`` and 0 for a null text or one without a letter."""
    bounded_batches(docs.sparkSession)
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(compact(model))
    src = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for b in batches:
            got = [score(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

    return src.mapInArrow(run, kinds + "lang_pred string, score double")


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def filter_documents(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is undetermined or doubtful; ``lang`` becomes the language found.

    The model is fitted on the documents' own languages, under the same folds as the query.
    """
    model = fit(docs.where(fold("doc_id", 3) != 1))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compact(model))

    @F.arrow_udf("struct<lang_pred:string, score:double>")
    def found(texts: pa.Array) -> pa.Array:
        score = _scorer(shared)
        got = [score(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    at = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    src = docs.select(*[F.col(c).alias(k) for c, k in at.items()])
    out = src.withColumn("_l", found.asNondeterministic()(F.col(at["text"]))).where((F.col("_l.lang_pred") != UND) & (F.col("_l.score") >= min_score))
    return out.select(*[(F.col("_l.lang_pred") if c == "lang" else F.col(k)).alias(c) for c, k in at.items()])
