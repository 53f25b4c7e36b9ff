"""Harmonic packing of token sequences.

Harmonic packing sorts lengths in classes of reciprocal capacity: a piece of
class k is longer than capacity / (k + 1) and at most capacity / k long, and a
bin of that class takes exactly k pieces, so bins are filled by counting alone,
class by class, on any number of workers. All k from 1 to the capacity are
classes. Documents may be cut, so a length that would leave more than ``SLACK``
unused places in the bins of its class is cut, into as few pieces as meet that
bound (mostly two); whole capacities are cut off first. What a class has left
over (fewer than k pieces) is bounded whatever the corpus, and is packed by
best fit in one task.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rockframe.llm.ranks import ranked
from rockframe.runtime import bounded_batches, materialize

CAPACITY, END_ID, BUCKET_ROWS = 1024, 0, 4096
#: Share of a bin, as 1 / SLACK, that pieces of one class may leave unused.
SLACK = 50
#: Encoded units kept per worker; the memory of the cache is bounded by it.
CACHE_UNITS = 400_000


@lru_cache(maxsize=1)
def load_encoder(path: str):
    """Text to ids as the tokenizers library gives for a byte-level BPE file; the file's added tokens have their ids wherever a text holds them.

    The vocabulary and merges of the file define the ids; they are run by
    tiktoken, which agrees with tokenizers on them and takes a fifth of its time.
    A merge's rank orders by the id of what it makes, which the loader checks.
    """
    import regex
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unprintable = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(unprintable)}
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: an added token takes space or needs word borders")
    added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: merge order is not the order of ids")
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # A single space between two characters that aren't space starts a token, whatever stands around it.
    units, doubled = regex.compile(r"(?<=\S) (?=\S)").split, re.compile(r"\s\s").search
    known: dict[str, bytes] = {}

    def fresh(unit: str) -> bytes:
        ids = array("I", core.encode_ordinary(unit))
        if sys.byteorder == "big":
            ids.byteswap()
        raw = ids.tobytes()
        if len(known) >= CACHE_UNITS:
            known.clear()
        if len(unit) <= 64:
            known[unit] = raw
        return raw

    def plain(text: str) -> bytes:
        single = doubled(text) is None and text[:1] != " " and text[-1:] != " "
        parts = text.split(" ") if single else units(text)
        parts[1:] = [" " + p for p in parts[1:]]
        out = list(map(known.get, parts))
        if None in out:
            out = [fresh(p) if ids is None else ids for p, ids in zip(parts, out, strict=True)]
        return b"".join(out)

    def encode(text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = apart(text)
        return plain(text) if len(parts) == 1 else b"".join(added[p] if i % 2 else plain(p) if p else b"" for i, p in enumerate(parts))

    return encode


@lru_cache(maxsize=4)
def _plan(capacity: int, slack: int = SLACK) -> tuple[tuple[int, ...], ...]:
    """Pieces, largest first, of each length below ``capacity``: the fewest that waste little, of those the least waste."""
    waste = [0.0] * (capacity + 1)
    fit = []
    for n in range(1, capacity + 1):
        k = capacity // n
        waste[n] = (capacity - k * n) / k
        if (capacity - k * n) * slack <= capacity:
            fit.append(n)
    best: list[tuple[int, float, int]] = [(0, 0.0, 0)]  # pieces, waste, the largest piece
    for r in range(1, capacity):
        best.append(min((best[r - n][0] + 1, best[r - n][1] + waste[n], -n) for n in fit if n <= r))
    out = []
    for r in range(capacity):
        parts = []
        while r:
            parts.append(-best[r][2])
            r += best[r][2]
        out.append(tuple(sorted(parts, reverse=True)))
    return tuple(out)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole capacities, then those of the rest."""
    full, rest = divmod(length, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    at = full * capacity
    for n in _plan(capacity)[rest]:
        out.append((at, n))
        at += n
    return out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document, its end id included; null texts are empty.

    One pass over the text, no shuffle; a piece's checksum needs no other row.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                ids = encode(t.as_py() or "") + end
                n = len(ids) // 4
                rows += [(i, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n) for s, k in cuts(n, capacity)]
            at, *cols = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *cols], names=PIECE)

    bounded_batches(docs.sparkSession)
    return src.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """A bin for each length (given in descending order): the fullest that still has room."""
    room: dict[int, list[int]] = {}
    out, bins = [], 0
    for n in lengths:
        left = next((r for r in range(n, capacity) if room.get(r)), None)
        if left is None:
            left, b, bins = capacity, bins, bins + 1
        else:
            b = room[left].pop()
        room.setdefault(left - n, []).append(b)
        out.append(b)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The columns of ``token_pieces`` with sequence_id and offset, for pieces of up to ``capacity``; other columns are left out.

    A piece's bin follows from its rank in its class: the pieces in lower
    buckets (a hash of the piece) plus its rank in its own, so buckets are
    filled independently and only counts meet. At most k - 1 pieces of class k
    are left over; they are packed together after all full bins.
    """
    pieces = materialize(pieces.select(*PIECE))
    spark = pieces.sparkSession
    rows = pieces.withColumn("k", F.expr(f"cast({capacity} div length AS int)"))
    counts = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class: capacity at most
    buckets = 1 << max(4, min(30, (sum(counts.values()) // bucket_rows).bit_length()))
    base, classes = 0, []
    for k in sorted(counts):
        classes.append((k, counts[k] // k, base))
        base += counts[k] // k
    rows = rows.withColumn("b", F.pmod(F.xxhash64(*PIECE), F.lit(buckets)))
    rows = ranked(rows, ["k"], "b", PIECE, "r").join(F.broadcast(spark.createDataFrame(classes, "k int, full bigint, base bigint")), "k")
    rows = materialize(rows.withColumn("sequence_id", F.expr("CASE WHEN r < full * k THEN base + r div k END")).select(*PIECE, "r", "sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    filled = rows.where("sequence_id IS NOT NULL").withColumn("offset", offset).select(*PIECE, "sequence_id", "offset")

    def leftover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in PIECE], strict=True)]
        found.sort(key=lambda r: (-r[2], r[0] is None, r[0] if r[0] is not None else 0, *r[1:]))
        at: Counter = Counter()
        out = []
        for r, b in zip(found, best_fit([r[2] for r in found], capacity), strict=True):
            out.append((*r, base + b, at[b]))
            at[b] += r[2]
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    id_type = pieces.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(c, pa.int64()) for c in [*PIECE[1:], "sequence_id", "offset"]]])
    ends = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{c} bigint" for c in [*PIECE[1:], "sequence_id", "offset"])
    # Fewer than the sum of all k that occur: a bound of the capacity alone.
    rest = rows.where("sequence_id IS NULL").select(*PIECE).coalesce(1).mapInArrow(leftover, ends)
    return filled.unionByName(rest)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs`` with their place; an empty table gives an empty result."""
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity)
