"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. All pairs of fingerprints
within ``RADIUS`` differing bits are found exactly: bits are cut in
``RADIUS + 1`` bands, so two such fingerprints agree on a whole band
(pigeonhole). Rows of equal band meet in one run of a sorted partition and are
compared vertically: bit b of all rows of a block is one big integer (a bit
plane), ``plane ^ (plane >> s)`` is the b-th difference of every row from the
one s places further, and a carry-save counter (ones, twos, dead) adds it to
every distance at once. A block is given up as soon as every pair in it has
passed the radius, mostly after a few planes.

Bands with very many fingerprints are cut again by the bits they do not share,
until each run is small, so no group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rockframe.operators.components import connected_components
from rockframe.runtime import bounded_batches, materialize, n_shuffle

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of one band that are compared in one task; larger bands are cut by further bits.
BAND_ROWS = 4096
#: Rows of small runs that share a block of bit planes, and the longest such run.
BLOCK_ROWS, SHORT_RUN = 65536, 48


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # bytes.lower: A-Z only; bytes.split: \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined, k, digest = b" ".join(words), shingle, xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = np.array(hashes[at : at + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer. Text never leaves the scan's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp bigint")


def _planes(fps: np.ndarray) -> list[int]:
    """Bit b of row i is bit i of the b-th integer."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(64)]


def close_at(planes: list[int], shift: int, alive: int, radius: int) -> int:
    """Bit i: rows i and i + shift, alive at first, differ in ``radius`` bits at most."""
    return _within(((p ^ (p >> shift)) for p in planes), alive, radius)


def _within(differences: Iterator[int], alive: int, radius: int) -> int:
    """Pairs of which at most ``radius`` of the difference planes are set.

    Carry-save counters: count[j] has bit j of every pair's count. They start
    at 2^k - 1 - radius, so passing the radius is a carry out of the top, which
    kills the pair; the block is abandoned once no pair lives.
    """
    k = radius.bit_length()
    bias = (1 << k) - 1 - radius
    count = [alive if bias >> j & 1 else 0 for j in range(k)]
    for carry in differences:
        carry &= alive
        for j in range(k):
            if not carry:
                break
            count[j], carry = count[j] ^ carry, count[j] & carry
        if carry:
            alive &= ~carry
            if not alive:
                return 0
    return alive


def _bits(mask: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _spanning(pairs: Iterator[tuple[int, int]], fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (of row numbers), as pairs of fingerprints: what a component needs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = x = root.get(p, p)
        return x

    out = []
    for i, j in pairs:
        if (a := find(i)) != (b := find(j)):
            root[max(a, b)] = min(a, b)
            out.append((int(fps[i]), int(fps[j])))
    return out


def _block_pairs(fps: np.ndarray, run: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Close rows of the same run, for rows sorted by run."""
    planes, shift = _planes(fps), 1
    while shift < len(fps):
        same = run[:-shift] == run[shift:]
        if not same.any():
            return
        alive = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        for i in _bits(found) if (found := close_at(planes, shift, alive, radius)) else ():
            yield int(i), int(i) + shift
        shift += 1


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of rows sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    run = np.repeat(np.arange(len(starts)), sizes)
    by_row, out = np.repeat(sizes, sizes), []
    short = np.flatnonzero((by_row > 1) & (by_row <= SHORT_RUN))
    if len(short):
        out += _spanning(_block_pairs(fps[short], run[short], radius), fps[short])
    for at, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        part = fps[at : at + n]
        out += _spanning(_block_pairs(part, np.zeros(n, np.int8), radius), part)
    return out


def _compare(radius: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal keys, fps, held
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = len(k) if last else int(np.flatnonzero(k == k[-1])[0])  # the last run may go on
            keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
            got = _links(k[:cut], f[:cut], radius) if cut > 1 else []
            ends = np.array(got, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

        for b in batches:
            if b.num_rows:
                keys.append(b.column(0).to_numpy(zero_copy_only=False))
                fps.append(b.column(1).to_numpy(zero_copy_only=False))
                if (held := held + b.num_rows) >= BLOCK_ROWS:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    n, edge = len(bits), [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[edge[i] : edge[i + 1]] for i in range(parts) if n and edge[i] < edge[i + 1]]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def band_links(fps: DataFrame, radius: int = RADIUS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(src, dst): links that connect all distinct ``fp`` within ``radius`` bits of each other.

    ``fps`` holds distinct values. Each round keys the fingerprints that still
    await comparison by the bits they must share; keys with 2 to ``band_rows``
    rows are compared, larger ones go to the next round under longer keys (a
    cut of the bits not yet shared in radius + 1 bands), so that every close
    pair still meets. ``band_rows`` is no cap: it only says when to cut again.
    """
    spark = fps.sparkSession
    parts = max(2 * n_shuffle(spark), 8)
    level = [tuple(band) for band in _cut(list(range(64)), radius + 1)]  # the bits each key shares
    waiting, done = fps.select("fp", F.lit(-1).alias("path")), None
    plan = [(-1, i, _mask(list(bits))) for i, bits in enumerate(level)]  # from path, to path, mask: (radius + 1)^round rows
    while True:
        ways = F.broadcast(spark.createDataFrame(plan, "path int, to int, mask bigint"))
        keyed = waiting.join(ways, "path").select("fp", F.col("to").alias("path"), F.xxhash64("to", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        keyed = materialize(keyed)
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialize(sizes)
        last = max(64 - len(bits) for bits in level) <= radius + 1
        fit = sizes if last else sizes.where(F.col("n") <= band_rows)
        ready = keyed.join(fit.select("key"), "key", "left_semi").select("key", "fp")
        links = ready.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(radius), "src bigint, dst bigint")
        links = materialize(links)
        done = links if done is None else done.union(links)
        large = sizes.where(F.col("n") > band_rows)
        if last or not large.limit(1).count():
            return done.distinct()
        waiting = keyed.join(large.select("key"), "key", "left_semi").select("fp", "path")
        plan, longer = [], []
        for i, bits in enumerate(level):
            for band in _cut([b for b in range(64) if b not in bits], radius + 1):
                plan.append((i, len(longer), _mask([*bits, *band])))
                longer.append((*bits, *band))
        level = longer


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: (id, fp, component): the smallest id reachable over links of at most ``radius`` bits.

    Null or empty texts have fingerprint 0 and are linked like any other; equal
    fingerprints are one node from the start, so copies cost no comparison.
    Rows that repeat an id each get a row; a null id gets a component from its
    fingerprint's other ids (null where it has none).
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")))
    comps = connected_components(band_links(nodes, radius))
    named = nodes.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("low").alias("root"))
    roots = named.join(least, "component").select("fp", F.col("root").alias("component"))
    return fps.join(roots, "fp").select("id", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Similar texts: bands of minima that propose pairs, bits of the sketch that judges them, differing bits beyond which a pair is given up.
MINIMA, BANDS, SKETCH_BITS, FAR = 5, 36, 2048, 383
#: Cells in which the shingles of a set are counted.
CELLS = 1024
#: Nearest partners that a row tries first in each run; rows of a run in one task, longer runs are dealt over several.
NEAREST, RUN_ROWS = 8, 4096
#: Logarithm of the most bits of a sieve (16 MB).
SIEVE_BITS = 27
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values (two rounds of multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TURNS = _mixed(np.arange(1, MINIMA * BANDS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_LANES = _mixed(np.arange(1, SKETCH_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of the runs of ``shingle`` words, ascending; fewer words are one run."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.full(n, min(shingle, len(w)), np.uint64)
    for j in range(min(shingle, len(w))):
        h = (h ^ w[j : j + n]) * _GOLD
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band of a shingle set: a hash of ``MINIMA`` of its minima.

    Two sets of similarity s agree on a band with probability s^MINIMA; at 0.8
    they agree on none of ``BANDS`` with less than one in a million.
    """
    h, least = _mixed(found.view(np.uint64)), np.full(len(_TURNS), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (_TURNS[:, None] * h[at : at + 4096]).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, MINIMA).T:
        key = _mixed((key ^ part) * _GOLD)
    return key.view(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """The SimHash of a shingle set in ``SKETCH_BITS`` bits.

    At similarity 0.8 two sketches differ in 310 bits on average, deviation 16:
    ``FAR`` is 4.5 deviations above (three pairs in a million, at 0.8 exactly).
    """
    h, ones = found.view(np.uint64), np.zeros(SKETCH_BITS, np.int64)
    for at in range(0, len(h), 255):
        lanes = _mixed(h[at : at + 255, None] + _LANES)
        ones += np.add.reduce(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def cells(found: np.ndarray) -> bytes:
    """Shingles of a set per cell, a cell being a run of bits of their hash; one byte each, 255 and more count as 255."""
    at = (_mixed(found.view(np.uint64)) & np.uint64(CELLS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=CELLS), 255).astype(np.uint8).tobytes()


def may_be_alike(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of these sizes and cells (a row each) can have the similarity; no pair that has it is refused.

    Two sets differ by at least as many shingles as their counts differ in all
    cells, so what they share is at most half of what is left of their sizes.
    """
    apart = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
    total = size_a.astype(np.int64) + size_b
    shared = (total - apart) / 2
    return shared >= similarity * (total - shared)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _row_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): a row is known by its id and a hash of its text, so repeated and null ids take part."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _banded(src: DataFrame, shingle: int) -> DataFrame:
    """(id, t, same, keys): a hash of the word sequence, and its band keys (none for a copy met before in the task)."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            same, keys = [], []
            for t in b.column(2):
                words = _split(t.as_py())
                same.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                keys.append(None if same[-1] in met else band_keys(shingle_set(words, shingle)))
                met.add(same[-1])
            cols = [pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names=["id", "t", "same", "keys"])

    return src.mapInArrow(run, f"id {kind}, t bigint, same bigint, keys array<bigint>")


def _sieve(values: DataFrame, column: str) -> np.ndarray:
    """Bits of the values of a column of longs, of a size with a bound: a clear bit means that a value is not among them.

    At most 2^SIEVE_BITS bits (a row of 4096 bytes for each 32768) reach the driver.
    """
    n = values.count()
    bits = 1 << max(15, min(SIEVE_BITS, (16 * n).bit_length()))
    at = (F.pmod(F.col(column), F.lit(bits)) + 1).alias("at")
    parts = values.select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _in_sieve(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (len(sieve) * 8 - 1)  # the remainder, as the size is a power of two
    return (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _sketched(src: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(same, sketch, cells, set) of the wanted word sequences, once each. Texts pass a sieve where they are read, and are never shuffled."""
    shared = src.sparkSession.sparkContext.broadcast(_sieve(wanted, "same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            same, sets = [], []
            for t in b.column(0):
                words = _split(t.as_py())
                key = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
                if int(key[0]) not in met and _in_sieve(shared.value, key)[0]:
                    met.add(int(key[0]))
                    same.append(int(key[0]))
                    sets.append(shingle_set(words, shingle))
            cols = [pa.array(same, pa.int64()), *(pa.array([f(s) for s in sets], pa.binary()) for f in (sketch, cells)), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["same", "sketch", "cells", "set"])

    known = src.select("text").mapInArrow(run, "same bigint, sketch binary, cells binary, set array<bigint>")
    known = materialize(known.join(wanted, "same", "left_semi"))
    if known.groupBy("same").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():  # copies that several tasks met
        known = materialize(known.dropDuplicates(["same"]))
    return known


def _matrix(values: pa.Array, width: int = SKETCH_BITS // 64, kind: type = np.uint64) -> np.ndarray:
    """Rows of numbers of a column of bytes: 64-bit words of sketches, or bytes of cells."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), width)


def _wide_planes(rows: np.ndarray) -> list[int]:
    """Bit b of all rows as one integer, for all b."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in np.packbits(bits.T, axis=1, bitorder="little")]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (src, dst, x, y) those whose sketches are within FAR bits, with their distance; a block of pairs is one comparison."""
    for b in batches:
        for at in range(0, b.num_rows, 8192):
            part = b.slice(at, 8192)
            x, y = _matrix(part.column(2)), _matrix(part.column(3))
            hit = _bits(found) if (found := _within(iter(_wide_planes(x ^ y)), (1 << len(x)) - 1, FAR)) else np.zeros(0, np.int64)
            cols = [part.column(i).take(pa.array(hit)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(_apart(x[hit], y[hit]))], names=["src", "dst", "d"])


def _run_pairs(run: np.ndarray, comp: np.ndarray, guest: np.ndarray, minor: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs within FAR bits, of one run and two components, one of them minor; guests meet only residents.

    Short runs lie side by side in one block, compared at every shift; in a
    long one each minor row is compared with all rows at once.
    """
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(run)])))
    by_row = np.repeat(sizes, sizes)
    short = np.flatnonzero((by_row > 1) & (by_row <= SHORT_RUN))
    for at in range(0, len(short), 16384):
        pick = short[max(0, at - SHORT_RUN) : at + 16384]  # runs that a cut divides meet in the overlap
        planes, r, c, m, g = _wide_planes(rows[pick]), run[pick], comp[pick], minor[pick], guest[pick]
        for s in range(1, SHORT_RUN):
            may = (r[:-s] == r[s:]) & (c[:-s] != c[s:]) & (m[:-s] | m[s:]) & ~(g[:-s] & g[s:])
            if not (r[:-s] == r[s:]).any():
                break
            if may.any() and (found := close_at(planes, s, int.from_bytes(np.packbits(may, bitorder="little").tobytes(), "little"), FAR)):
                i = _bits(found)
                yield pick[i], pick[i + s]
    for at, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        part = slice(at, at + n)
        planes, full = _wide_planes(rows[part]), (1 << n) - 1
        resident = ~guest[part]
        order = np.arange(n)
        for i in np.flatnonzero(minor[part]).tolist():
            # Two minor residents meet once; a guest meets residents only.
            may = resident & (comp[part] != comp[at + i]) & (~minor[part] | (order > i) | bool(guest[at + i]))
            if not may.any():
                continue
            own = np.unpackbits(rows[at + i : at + i + 1].view(np.uint8), bitorder="little")
            found = _within((p ^ full if o else p for p, o in zip(planes, own.tolist(), strict=True)), int.from_bytes(np.packbits(may, bitorder="little").tobytes(), "little"), FAR)
            if found:
                j = at + _bits(found)
                yield np.full(len(j), at + i), j


def _cross_pairs(nearest: int | None, similarity: float):
    """A task over rows (run, same, component, guest, minor, size, sketch, cells) sorted by run: distinct pairs (src, dst) whose sets may be alike; only each row's ``nearest`` where given."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def found(cols: list) -> pa.RecordBatch:
        run, same, comp, guest, minor, size = (np.asarray(c) for c in cols[:6])
        rows, counts, got = cols[6], cols[7], []
        for i, j in _run_pairs(run, comp, guest, minor, rows):
            for k in range(0, len(i), 2048):
                a, b = i[k : k + 2048], j[k : k + 2048]
                may = may_be_alike(size[a], size[b], counts[a], counts[b], similarity)
                got.append((a[may], b[may]))
        i, j = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        if nearest and len(i):
            d = np.concatenate([_apart(rows[i[k : k + 8192]], rows[j[k : k + 8192]]) for k in range(0, len(i), 8192)])
            ends = np.where(minor[i], i, j)  # the row that tries
            order = np.lexsort((same[j], same[i], d, ends))
            first = np.concatenate(([True], ends[order][1:] != ends[order][:-1]))
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            i, j = i[order[rank < nearest]], j[order[rank < nearest]]
        pairs = np.unique(np.stack((np.minimum(same[i], same[j]), np.maximum(same[i], same[j])), axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [*[c.to_numpy(zero_copy_only=False) for c in b.columns[:6]], _matrix(b.column(6)), _matrix(b.column(7), CELLS, np.uint8)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
            if count + cut >= RUN_ROWS and (cut or held[-1][0][-1] != cols[0][0]):
                held.append([c[:cut] for c in cols])
                yield found([np.concatenate(x) for x in zip(*held, strict=True)])
                held, count = [], 0
                cols = [c[cut:] for c in cols]
            held.append(cols)
            count += len(cols[0])
        if held:
            yield found([np.concatenate(x) for x in zip(*held, strict=True)])

    return task


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, t, component) of each row, components named by one of their texts."""
    spark = docs.sparkSession
    parts = max(2 * n_shuffle(spark), 8)
    bounded_batches(spark)
    src = _row_texts(docs, id_col, text_col)
    rows = materialize(_banded(src, shingle))
    keyed = rows.where("keys IS NOT NULL").select("same", F.explode("keys").alias("key"))
    # Copies from several tasks repeat (same, key): a run needs two texts.
    lead = F.min_by("same", F.xxhash64("same", "key")).alias("lead")
    shared = keyed.groupBy("key").agg(lead, F.min("same").alias("a"), F.max("same").alias("b")).where("a < b").select("key", "lead")
    runs = materialize(keyed.join(shared, "key").distinct())

    known = _sketched(src, materialize(runs.select("same").distinct()), shingle)
    sketches, sets = known.select("same", "sketch"), known.select("same", "set")
    judges = known.select("same", F.size("set").alias("size"), "sketch", "cells")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("same").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("same").alias("dst"), F.col("set").alias("b")), "dst")
        n = F.size(F.array_intersect("a", "b"))
        return materialize(both.where(n >= similarity * (F.size("a") + F.size("b") - n)).select("src", "dst"))

    # First each text with the nearest of the leaders of its runs.
    led = runs.where("same <> lead").select("same", "lead").distinct()
    led = led.join(sketches.withColumnRenamed("sketch", "x"), "same").join(sketches.select(F.col("same").alias("lead"), F.col("sketch").alias("y")), "lead")
    close = led.select(F.col("same").alias("src"), F.col("lead").alias("dst"), "x", "y").mapInArrow(_near_pairs, "src bigint, dst bigint, d bigint")
    tried = materialize(close.groupBy("src").agg(F.min_by("dst", F.struct("d", "dst")).alias("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    links = alike(tried)
    # Then rows of runs that are not yet one component: the nearest of each row, and at last all pairs.
    for nearest in (NEAREST, None):
        comps = connected_components(links)
        placed = runs.join(comps.withColumnRenamed("id", "same"), "same", "left").select("key", "same", F.coalesce("component", "same").alias("component"))
        placed = materialize(placed)
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        parted = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
        cut = F.expr(f"cast(ceil(n / {RUN_ROWS}) AS int)")
        open_ = placed.join(parted.select("key", "major", cut.alias("cut")), "key").withColumn("minor", F.col("component") != F.col("major"))
        home = F.pmod(F.xxhash64("same", "key"), "cut").cast("int")
        guests = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("cut") - 1)).otherwise(F.array(home))
        dealt = open_.withColumn("home", home).withColumn("at", F.explode(guests)).withColumn("run", F.xxhash64("key", "at")).withColumn("guest", F.col("at") != F.col("home"))
        dealt = dealt.select("same", "run", "component", "guest", "minor").join(judges, "same").select("run", "same", "component", "guest", "minor", "size", "sketch", "cells")
        pairs = dealt.repartition(parts, "run").sortWithinPartitions("run", "same").mapInArrow(_cross_pairs(nearest, similarity), "src bigint, dst bigint")
        pairs = materialize(pairs.distinct().join(tried, ["src", "dst"], "left_anti"))
        links = links.union(alike(pairs))
        tried = tried.union(pairs)
    comps = connected_components(links)
    return rows.select("id", "t", "same").join(comps.withColumnRenamed("id", "same"), "same", "left").select("id", "t", F.coalesce("component", "same").alias("component"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of each distinct id: texts linked where the Jaccard similarity of their word shingles is ``similarity`` (0.8 or more).

    Bands of minima of the shingle sets propose pairs, bit-sliced comparison of
    wide SimHashes of the sets judges them, counts of their shingles in cells
    refuse those that cannot be alike, and what passes is decided by the whole
    sets. A text is first compared with the leader of each of its
    runs (texts of one band key), so a large group of near copies mostly joins
    in work proportional to its rows; afterwards only rows of other components
    than the largest of their run are compared with it; first with the 8
    nearest, so that leaves at most 8 pairs per row and run, and then with all,
    of which the counts leave few that are not alike. No pair is dropped for
    the size of a run: long ones are dealt over several tasks. Texts of equal
    words are one node from the start. Rows without an id link others.
    """
    rows = materialize(_similar_rows(docs, id_col, text_col, shingle, similarity))
    roots = rows.groupBy("component").agg(F.min("id").alias("root"))
    return rows.where("id IS NOT NULL").join(roots, "component").groupBy("id").agg(F.min("root").alias("component"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one with the smallest id, rows without one coming last.

    Rows that repeat an id are rows of their own, told apart by their texts.
    Texts that pass no sieve of those that go are kept where they are; only the
    others meet the table of what goes.
    """
    rows = materialize(_similar_rows(docs, id_col, text_col, shingle, similarity).groupBy("component", "id", "t").agg(F.count(F.lit(1)).alias("c")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x")
    roots = rows.groupBy("component").agg(first, F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).where("n > 1").select("component", F.col("x.id").alias("i"), F.col("x.t").alias("h"))
    judged = rows.join(roots, "component").withColumn("root", F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h")))
    judged = materialize(judged.select(F.col("id").alias("_gone_id"), F.col("t").alias("_gone_t"), "c", "root").where("NOT root OR c > 1"))

    shared = docs.sparkSession.sparkContext.broadcast(_sieve(judged.select("_gone_t"), "_gone_t"))

    @F.arrow_udf("boolean")
    def maybe(t: pa.Array) -> pa.Array:
        return pa.array(_in_sieve(shared.value, t.to_numpy(zero_copy_only=False)))

    def of(which: DataFrame, how: str) -> DataFrame:
        some = docs.where(maybe(F.xxhash64(text_col)))
        return some.join(which.select("_gone_id", "_gone_t"), some[id_col].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(some[text_col]) == F.col("_gone_t")), how)

    out = docs.where(~maybe(F.xxhash64(text_col))).unionByName(of(judged, "left_anti").select(*docs.columns))
    twice = judged.where("root")
    if twice.limit(1).count():
        again = of(twice, "left_semi").withColumn("_t", F.xxhash64(text_col)).dropDuplicates([id_col, "_t"])
        out = out.unionByName(again.select(*docs.columns))
    return out
