"""SentencePiece BPE, encoded by a table of last tokens and decoded.

Merging is defined by priorities: again and again the adjacent pair whose union
is the best-scored piece is joined. Each prefix of a text has one encoding, and
what follows can't be told from the prefix except through its last token, so it
is enough to store one token per prefix: among the pieces that end there (an
automaton finds them all in one pass), the one that the last token of the
prefix before it tolerates. Two tokens tolerate each other if merging their
joint text from scratch gives just these two. The ids are then read backwards
from the end of the table. That takes time in proportion to the text for any
text, where merging a priority queue does not.

A character that no piece has joins nothing: it cuts the text, and becomes the
tokens of its bytes. No piece has a space mark behind another character, so the
text is also cut before each run of marks; each cut part is encoded by itself,
and frequent ones are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rockframe.runtime import bounded_batches

MARK = "▁"
#: Parts and token pairs remembered per worker; its memory is bounded by them.
CACHE_PARTS, CACHE_PAIRS = 600_000, 2_000_000


class PieceCodec:
    """Encoder and decoder of one BPE model file (identity normalisation, byte fallback)."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.piece[i][3:-1], 16) for i in range(size) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id) or {c for p in self.id for c in p} - set(self.id) or len(self.id_of_byte) != 256:
            raise ValueError(f"{path}: not a model of the kind this codec reads")
        auto = ahocorasick.Automaton()
        self.made = {p for p in self.id if len(p) == 1 or self._merge(p) == [p]}  # others never come out of merging
        for p in self.made:
            auto.add_word(p, (self.id[p], len(p)))
        self.beside = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        auto.make_automaton()
        self.matches = auto.iter
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        strange = "".join(re.escape(c) for c in sorted(c for c in self.id if len(c) == 1))
        self.stretches = re.compile(f"[{strange}]+|[^{strange}]+").findall
        self.strange = re.compile(f"[^{strange}]").search
        self.known: dict[str, list[int]] = {}
        self.tolerates: dict[int, bool] = {}
        self.surface = [p.replace(MARK, " ") for p in self.piece]
        for i in range(size):
            if sp.is_control(i):
                self.surface[i] = ""

    def _merge(self, text: str) -> list[str]:
        """The definition, for short texts."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        """Whether merging from scratch leaves these two as they are; remembered."""
        if len(self.tolerates) >= CACHE_PAIRS:
            self.tolerates.clear()
        p, q = self.piece[a], self.piece[b]
        if p[-1] + q[0] not in self.beside:  # nothing spans the seam
            ok = True
        else:  # a token that comes out of merging is what its own text gives
            ok = p + q not in self.made and self._merge(p + q) == [p, q]
        self.tolerates[a << 32 | b] = ok
        return ok

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        if (whole := self.id.get(text)) is not None and len(text) == 1:
            return [whole]
        last, width = [0] * (len(text) + 1), [0] * (len(text) + 1)
        tolerates = self.tolerates.get
        for end, (i, n) in self.matches(text):
            end += 1
            if not width[end]:
                if (start := end - n) == 0:
                    last[end], width[end] = i, n
                elif width[start]:
                    if (ok := tolerates(last[start] << 32 | i)) is None:
                        ok = self._pair(last[start], i)
                    if ok:
                        last[end], width[end] = i, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= width[at]
        return out[::-1]

    def _part(self, part: str) -> list[int]:
        out: list[int] = []
        if self.strange(part) is None:
            return self._stretch(part)
        for s in self.stretches(part):
            if s[0] in self.id:
                out += self._stretch(s)
            else:
                out += [self.id_of_byte[b] for b in s.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without begin or end; an empty text has none."""
        if not text:
            return []
        parts = self.parts(MARK + text.replace(" ", MARK))
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self._remembered(p) if ids is None else ids for p, ids in zip(parts, found, strict=True)]
        return list(chain.from_iterable(found))

    def _remembered(self, part: str) -> list[int]:
        ids = self._part(part)
        if len(part) <= 64:
            if len(self.known) >= CACHE_PARTS:
                self.known.clear()
            self.known[part] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first one goes, runs of byte tokens are read as UTF-8."""
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            text, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                else:
                    if held:
                        text.append(_utf8(bytes(held)))
                        held.clear()
                    text.append(surface[i])
            text = "".join(text) + _utf8(bytes(held))
        return text[1:] if ids and self.piece[ids[0]].startswith(MARK) else text


@lru_cache(maxsize=1)
def codec_of(path: str) -> PieceCodec:
    """One codec, and one memory, per worker process."""
    return PieceCodec(path)


def _utf8(raw: bytes) -> str:
    """Each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded), one row per row of ``docs``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            ids = [codec.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``, made where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        names = [str(i) for i in range(len(codec.piece))]
        sha = hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(sha(",".join([names[i] for i in ids]).encode()).hexdigest())
                d.append(sha(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
