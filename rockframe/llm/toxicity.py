"""Toxic spans by a linear-chain conditional random field, and what they make of a document.

Only documents are labelled, so the labels of tokens are latent: a clean
document has no toxic token, a toxic one at least one (multiple-instance
learning). The field is fitted by expectation-maximisation on the exact
likelihood of that: tokens of a toxic document are labelled by their marginals
given that not all are clean, those of a clean one as clean, and the weights
follow by gradient steps, batch by batch. Its features are the word, its ends,
and the words before and after. Forward-backward marginals over the whole text
give each token's probability; runs of tokens above one half are the offending
spans, and a logistic regression on the strongest marginal and the expected
number of toxic tokens, fitted on the sample's document labels, gives the
score.

The sample is bounded: about ``FIT_ROWS`` labelled texts of each class, whole,
taken in the order of a hash while they have ``FIT_CHARS`` characters together.
It is the one thing that is brought to the driver. Features are hashed to
``SLOTS`` weights, so the model has one size and is broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rockframe.runtime import bounded_batches, materialize

FIT_ROWS, FIT_CHARS = 2000, 32_000_000
#: Words of fewer sample texts have no weight of their own, only those of their ends.
MIN_DOCS, SLOTS, BATCH, STEPS = 4, 1 << 18, 64, 250
#: Words remembered per worker, and characters of the texts that are swept in step.
CACHE_WORDS, SCORE_CHARS, TRAIN_SEED = 400_000, 2_000_000, 5
_token = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the text as it stands, each in lower case."""
    text = text or ""
    low = text.lower()
    if len(low) == len(text):  # no letter has a longer lower form, so the runs are the same
        return _token.findall(low)
    return [t.lower() for t in _token.findall(text)]


def _slot(kind: str, value: str) -> int:
    return zlib.crc32((kind + value).encode("utf-8", "surrogatepass")) % SLOTS


def slots_of(word: str) -> tuple[int, ...]:
    """Of a word: itself, its first and last letters, and itself as the neighbour before and behind another."""
    return _slot("w", word), _slot("p", word[:4]), _slot("s", word[-4:]), _slot("l", word), _slot("r", word)


class Field:
    """Two labels (clean 0, toxic 1): w scores toxic against clean, t[a, b] the step from a to b."""

    def __init__(self):
        self.w = np.zeros(SLOTS)
        self.bias = -4.0
        self.t = np.zeros((2, 2))
        self.doc = (-3.0, 6.0, 0.0)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 3))

    def __getstate__(self):
        return self.__dict__ | {"rows": {}, "table": np.zeros((0, 3))}

    def known(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own score, to that of the word behind it and to that of the word before it."""
        a, b, c, l, r = slots_of(word)
        return self.w[a] + self.w[b] + self.w[c] + self.bias, self.w[l], self.w[r]

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Score of every token, flat; words are remembered up to a bound."""
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, np.zeros((0, 3))
        flat = [w for t in texts for w in t]
        new = [w for w in dict.fromkeys(flat) if w not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.table = np.concatenate((self.table, np.array([self.known(w) for w in new])))
        at = self.table[np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))].reshape(-1, 3)
        return _with_neighbours(at, np.array([len(t) for t in texts], np.int64))

    def sweep(self, e: np.ndarray, size: np.ndarray) -> tuple:
        """Forward and backward odds of every token, flat, and the logarithm of each text's chance to be all clean.

        All texts go in step, the longest first. In odds, a step is
        o' = exp(e) (t01 + t11 o) / (t00 + t10 o), so the recursion holds one
        number per text and never under- or overflows.
        """
        order = np.argsort(-size, kind="stable")
        start = (np.cumsum(size) - size)[order]
        long = size[order]
        e = np.exp(np.clip(e, -30, 30))
        (a, b), (c, d) = np.exp(self.t)
        most = int(long[0]) if len(long) else 0
        live = np.searchsorted(-long, -np.arange(most), side="left")  # texts longer than each position
        fwd, clean, o = np.empty_like(e), np.zeros(len(size)), None
        for p in range(most):
            n = live[p]
            if o is None:
                o = e[start[:n]]
            else:
                clean[:n] -= np.log1p(c / a * o[:n])
                o = np.concatenate((e[start[:n] + p] * (b + d * o[:n]) / (a + c * o[:n]), o[n:]))
            fwd[start[:n] + p] = o[:n]
        if o is not None:
            clean[: len(o)] -= np.log1p(o)
        back, o = np.ones_like(e), np.ones(len(size))
        for p in range(most - 2, -1, -1):
            n = live[p + 1]  # those with a token to the right
            nxt = e[start[:n] + p + 1] * o[:n]
            o[:n] = (c + d * nxt) / (a + b * nxt)
            back[start[:n] + p] = o[:n]
        chance = np.empty(len(size))
        chance[order] = clean
        return e, fwd, back, chance

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of every token of every text."""
        size = np.array([len(t) for t in texts], np.int64)
        _, fwd, back, _ = self.sweep(self.scores(texts), size)
        odds = fwd * back
        return np.split(odds / (1 + odds), np.cumsum(size)[:-1]) if len(texts) else []

    def fit(self, texts: list[list[str]], toxic: list[int], rate: float = 0.1, l2: float = 7e-4) -> None:
        """Adam on the mean log-likelihood that toxic texts have a toxic token and others none."""
        words = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        docs = Counter(w for t in texts for w in set(t))
        slots = np.array([slots_of(w) for w in words], np.int64).reshape(-1, 5)
        often = np.array([docs[w] >= MIN_DOCS for w in words])[:, None] * np.array([1.0, 0, 0, 1, 1]) + np.array([0.0, 1, 1, 0, 0])
        ids = [np.fromiter(map(words.__getitem__, t), np.int64, len(t)) for t in texts]
        y, rng = np.array(toxic), np.random.default_rng(TRAIN_SEED)
        long = np.array([len(t) for t in texts])
        sides = [np.flatnonzero(y == k) for k in (0, 1)]
        sides = [x[np.argsort(long[x], kind="stable")] for x in sides]
        params = {"w": self.w, "b": np.array([self.bias]), "t": self.t}
        m = {k: np.zeros_like(v) for k, v in params.items()}
        v = {k: np.zeros_like(x) for k, x in params.items()}
        step, batches = 0, max(1, len(texts) // BATCH)
        parts = [np.concatenate(p) for p in zip(*[np.array_split(x, batches) for x in sides], strict=True)]  # of both kinds, of like length
        for _ in range(-(-STEPS // batches)):
            for pick in (parts[i] for i in rng.permutation(batches)):
                size = np.array([len(ids[i]) for i in pick], np.int64)
                flat = np.concatenate([ids[i] for i in pick])
                if not len(flat):
                    continue
                own = (params["w"][slots] * often)
                table = np.stack((own[:, :3].sum(1) + params["b"][0], own[:, 3], own[:, 4]), axis=1)
                e, fwd, back, chance = self.sweep(_with_neighbours(table[flat], size), size)
                odds = fwd * back
                p = odds / (1 + odds)
                bad = np.repeat(y[pick] > 0, size)
                some = np.repeat(1 / np.maximum(-np.expm1(chance), 1e-6), size)
                q = np.where(bad, np.minimum(p * some, 1.0), 0.0)
                g = q - p
                ends = np.cumsum(size)
                last = np.zeros(len(flat), bool)
                last[ends[size > 0] - 1] = True
                left = np.flatnonzero(~last)  # tokens with one to the right
                x = np.exp(self.t)
                right = e[left + 1] * back[left + 1]
                both = np.stack([np.full(len(left), x[0, 0]), x[0, 1] * right, fwd[left] * x[1, 0], fwd[left] * x[1, 1] * right])
                both /= both.sum(0)
                given = both * some[left]
                given[0] = 1 - given[1:].sum(0)
                gt = np.where(bad[left], given, np.array([[1.0], [0], [0], [0]])) - both
                n_words = len(words)
                before, behind = np.zeros(n_words), np.zeros(n_words)
                if len(left):
                    before = np.bincount(flat[left], g[left + 1], n_words)
                    behind = np.bincount(flat[left + 1], g[left], n_words)
                own = np.bincount(flat, g, n_words)
                by_word = np.stack((own, own, own, before, behind), axis=1) * often
                grads = {"w": np.bincount(slots.ravel(), by_word.ravel(), SLOTS), "b": np.array([g.sum()]), "t": gt.sum(1).reshape(2, 2)}
                step += 1
                for k, got in grads.items():
                    got = got / len(pick) - l2 * params[k] * (k != "b")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * got, 0.999 * v[k] + 0.001 * got * got
                    params[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.bias = float(params["b"][0])

    def summary(self, m: np.ndarray) -> tuple[float, float]:
        """The strongest marginal, and the log of one plus the expected number of toxic tokens among the likely ones."""
        if not len(m):
            return 0.0, 0.0
        return float(m.max()), math.log1p(float(m[m > 0.2].sum()))

    def score(self, m: np.ndarray) -> float:
        x, y = self.summary(m)
        a, b, c = self.doc
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _with_neighbours(table: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of tokens from what each adds to itself, to the one behind and to the one before, within texts."""
    e = table[:, 0].copy()
    if len(e) > 1:
        inner = np.ones(len(e), bool)
        inner[(np.cumsum(size) - size)[size > 0]] = False  # first tokens
        at = np.flatnonzero(inner)
        e[at] += table[at - 1, 1]
        e[at - 1] += table[at, 2]
    return e


def _apart(texts: list[list[str]]) -> list[int]:
    """Numbers of texts of which no earlier one shares a least hash of word triples: near copies count once in the fit."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(" ".join(t[j : j + 3]).encode()) for j in range(max(1, len(t) - 2))], np.uint64)
        own = {(k, int(((h * k + 7919 * k) % 4294967291).min())) for k in (1, 40503, 69069, 1664525)}
        if seen.isdisjoint(own):
            out.append(i)
        seen |= own
    return out


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_chars: int) -> list:
    """Rows (t, y, c) of about ``fit_rows`` texts of each class; c is how many labelled texts one stands for.

    Hashes of texts meet the labels first, so only chosen texts leave the scan:
    their ids are bounded by the sample's size, so they are broadcast.
    """
    hashed = docs.where("t IS NOT NULL").select("id", F.xxhash64(F.lit(3), "t").alias("h"), F.char_length("t").alias("n"))
    pool = materialize(hashed.join(labels, "id"))
    n = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = {y: min(1.0, fit_rows / max(1, n.get(y, 0))) for y in (0, 1)}
    limit = F.when(F.col("y") == 1, F.lit(int(share[1] * (1 << 20)) + 1)).otherwise(F.lit(int(share[0] * (1 << 20)) + 1))
    weight = F.when(F.col("y") == 1, F.lit(1 / share[1])).otherwise(F.lit(1 / share[0]))
    chosen = pool.where(F.pmod("h", F.lit(1 << 20)) < limit)
    one = chosen.groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y"), F.max("n").alias("n")).orderBy("h").limit(3 * fit_rows).withColumn("c", weight)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))  # over the sample's rows
    one = materialize(one.withColumn("upto", before).where(F.col("upto") <= fit_chars).select("h", "id", "y", "c"))
    rows = docs.join(F.broadcast(one), "id").where(F.xxhash64(F.lit(3), "t") == F.col("h"))
    return sorted(rows.select("h", "t", "y", "c").dropDuplicates(["h"]).collect(), key=lambda r: r["h"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Field:
    """A field fitted on a bounded sample of labelled texts; without both kinds of text, one that finds nothing.

    Of labels that repeat an id the highest counts, for all rows of that id;
    null labels and null ids don't count.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    got = _sample(src, known, fit_rows, fit_chars)
    texts = [tokens_of(r["t"]) for r in got]
    apart = _apart(texts)
    got, texts = [got[i] for i in apart], [texts[i] for i in apart]
    y = [r["y"] for r in got]
    field = Field()
    if len(set(y)) == 2:
        field.fit(texts, y)
        field.doc = _logistic(np.array([field.summary(m) for m in field.marginals(texts)]), np.array(y), np.array([r["c"] for r in got]))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted, slightly ridged logistic regression by Newton steps."""
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    weight = weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(3)
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * b), -3, 3)
    return tuple(b.tolist())


def spans_of(text: str, m: np.ndarray) -> list[dict]:
    """(start, end) of each run of tokens more likely toxic than not, in code points of the text as it stands."""
    hot = set(np.flatnonzero(m > 0.5).tolist())
    if not hot:
        return []
    low = text.lower()
    out, last = [], -2
    for k, t in enumerate(_token.finditer(low if len(low) == len(text) else text)):
        if k in hot:
            if k == last + 1:
                out[-1]["end"] = t.end()
            else:
                out.append({"start": t.start(), "end": t.end()})
            last = k
    return out


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans), one row per row of ``docs``; spans as in ``spans_of``.

    Null and empty texts get the score of a text without a toxic token. Texts
    are swept whole, a very long one by itself.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            ends = np.cumsum([len(t) for t in texts]) // SCORE_CHARS
            for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                part = [texts[i] for i in at]
                ms = f.marginals([tokens_of(t) for t in part])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([f.score(m) for m in ms], pa.float64()), pa.array([spans_of(t, m) for t, m in zip(part, ms, strict=True)], span)], names=["id", "score", "spans"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint>>")
