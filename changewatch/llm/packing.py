"""Packing: vector bin packing of token pieces by the dot-product heuristic.

Every piece of a document asks for three things at once: tokens, one segment,
and loss-bearing tokens. A sequence is filled by taking, again and again, the
waiting piece that fits and whose demand has the largest dot product with what
is left of the sequence (both as fractions of the limits). When no piece fits,
the one that can give most is cut to fill the gap, if cutting is allowed. A
sequence that the other limits leave short of tokens, and what is left at the
end of a partition, is cut back to a power of two of tokens, which needs no
padding.

A partition packs what it reads, in one pass, holding a bounded window of
pieces. So there is no shuffle, no group to gather, and a lost task redoes
only its own partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewatch.llm.common import by_bytes
from changewatch.llm.token_counts import encoder

BATCH_BYTES = 2_000_000
#: A sequence's number is its partition's number times this, plus its number there.
PER_PARTITION = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 8
    loss: int = 2040
    #: Pieces that wait for a place in one partition.
    window: int = 192
    #: Whether a piece may be cut to fill a gap.
    cut: bool = True
    #: Tokens of padding up to which a sequence need not be cut back.
    slack: int = 16

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.window) < 1:
            raise ValueError("limits must be at least 1")


class Packer:
    """Packs a stream of pieces. ``put`` and ``finish`` return the sequences that became full.

    A piece is (key, start, length, context): ``context`` of its first tokens
    bear no loss. A sequence is (pieces, tokens padded to).
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.need = np.zeros((limits.window + limits.segments, 3))
        self.pieces: list[tuple] = []

    def _wait(self, piece: tuple) -> None:
        n = len(self.pieces)
        if n == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[n] = piece[2], 1, piece[2] - piece[3]
        self.pieces.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.pieces[i], self.pieces.pop()
        if i < len(self.pieces):
            self.pieces[i] = last
            self.need[i] = self.need[len(self.pieces)]
        return piece

    def _fill(self) -> list[tuple]:
        """One sequence: as many tokens as the limits allow, or a power of two of them."""
        left = self.caps.copy()
        out: list[tuple] = []
        while self.pieces and left[0] >= 1 and left[1] >= 1:
            need = self.need[: len(self.pieces)]
            score = need @ (left / self.caps**2)
            score[(need > left).any(axis=1)] = -1.0
            i = int(score.argmax())
            if score[i] >= 0:
                piece = self._take(i)
            elif self.limits.cut:
                # of each piece its first tokens may come: those without loss, and as many more as loss is left
                sizes = np.minimum(np.minimum(left[0], need[:, 0]), left[2] + need[:, 0] - need[:, 2])
                i = int(sizes.argmax())
                if sizes[i] < 1:
                    break
                piece = self._cut(i, int(sizes[i]))
            else:
                break
            out.append(piece)
            left -= (piece[2], 1, piece[2] - piece[3])
        total = sum(p[2] for p in out)
        if self.limits.cut and self.limits.tokens - total > self.limits.slack:
            self._shorten(out, 1 << (total.bit_length() - 1))
        return out

    def _cut(self, i: int, size: int) -> tuple:
        """The first ``size`` tokens of a waiting piece; the rest waits on."""
        key, start, length, context = self.pieces[i]
        if size == length:
            return self._take(i)
        self.pieces[i] = rest = (key, start + size, length - size, max(0, context - size))
        self.need[i] = rest[2], 1, rest[2] - rest[3]
        return key, start, size, min(context, size)

    def _shorten(self, out: list[tuple], tokens: int) -> None:
        """Put back what exceeds ``tokens``, from the end of a sequence."""
        over = sum(p[2] for p in out) - tokens
        while over:
            key, start, length, context = out.pop()
            keep = max(0, length - over)
            if keep:
                out.append((key, start, keep, min(context, keep)))
            self._wait((key, start + keep, length - keep, max(0, context - keep)))
            over -= length - keep

    def put(self, key, length: int, context: int = 0) -> Iterator[list[tuple]]:
        """Add an example. Raises ValueError if it can't fit in any sequence and must not be cut."""
        lim, start = self.limits, 0
        if not lim.cut and (length > lim.tokens or length - context > lim.loss):
            raise ValueError(f"an example of {length} tokens, {length - context} bearing loss, exceeds the limits")
        while lim.cut and length - start >= lim.tokens and lim.tokens - max(0, context - start) <= lim.loss:
            yield [(key, start, lim.tokens, min(lim.tokens, max(0, context - start)))]  # as the longest demand, it would be alone
            start += lim.tokens
        while start < length:
            # a long text waits in pieces that a sequence can take whole
            size = length - start
            if lim.cut:
                size = min(size, lim.tokens, max(0, context - start) + lim.loss)
            self._wait((key, start, size, min(size, max(0, context - start))))
            start += size
            while len(self.pieces) > lim.window:
                yield self._fill()

    def finish(self) -> Iterator[list[tuple]]:
        while self.pieces:
            yield self._fill()


def padded(tokens: int, limit: int) -> int:
    """The length that a sequence is padded to: its own at a power of two, else the limit."""
    return tokens if tokens & (tokens - 1) == 0 else limit


def pack_examples(examples: DataFrame, limits: Limits = Limits(), *, key: str = "example_id", tokens: str = "n_tokens", context: str = "n_context") -> DataFrame:
    """Pack rows of (key, tokens, tokens that bear no loss) without their ids.

    Returns key, start, length, loss_tokens, sequence_id, offset, padded_length.
    Null counts are 0; an example without tokens gets no piece; context is
    held between 0 and the example's tokens. Repeated keys are packed each for
    itself. Other columns are not read.
    """
    n = F.greatest(F.lit(0), F.coalesce(F.col(tokens).cast("long"), F.lit(0)))
    c = F.greatest(F.lit(0), F.least(n, F.coalesce(F.col(context).cast("long"), F.lit(0))))
    rows = examples.select(F.col(key).alias("key"), n.alias("n"), c.alias("c"), F.spark_partition_id().cast("long").alias("part"))
    schema = rows.select("key").schema.add("start", "long").add("length", "long").add("loss_tokens", "long").add("sequence_id", "long").add("offset", "long").add("padded_length", "long")
    key_type = None

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, part, kind = Packer(limits), 0, 0, key_type

        def rows_of(full):
            nonlocal number
            out = []
            for pieces in full:
                offset, total = 0, sum(p[2] for p in pieces)
                for k, start, length, ctx in pieces:
                    out.append((k, start, length, length - ctx, part * PER_PARTITION + number, offset, padded(total, limits.tokens)))
                    offset += length
                number += 1
            return out

        def batch_of(out):
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names=schema.names)

        for batch in batches:
            kind, out = batch.schema.field("key").type, []
            for k, n_, c_, part in zip(*(batch.column(x).to_pylist() for x in ("key", "n", "c", "part")), strict=True):
                if n_:
                    out += rows_of(packer.put(k, n_, c_))
            if out:
                yield batch_of(out)
        if out := rows_of(packer.finish()):
            yield batch_of(out)

    out = rows.mapInArrow(pack, schema)
    return out.withColumnRenamed("key", key)


def heading(text: str) -> str:
    """The first line of a text that has others: what the rest is conditioned on, as a prompt is; else ''."""
    head, feed, rest = text.partition("\n")
    return head if feed and rest.strip() else ""


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), *, ranks: str | None = None, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenize documents, end each with ``end_id``, and pack them.

    Returns per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), doc_tokens
    (with the end id), sequence_id, offset (in the sequence, gapless from 0),
    loss_tokens, padded_length. The ids of a document's heading (``heading``)
    bear no loss, nor does its first id, which nothing before it predicts. Null text is empty and gives one id.
    Rows that repeat a doc_id are packed each for itself. Texts of any length
    are packed whole. An empty table gives an empty result. Other columns are
    not read, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.spark_partition_id().cast("long").alias("_part"))
    schema = rows.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "padded_length"):
        schema = schema.add(name, "long")
    end = struct.pack("<I", end_id)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, number, part, kind = encoder(path, ranks), Packer(limits), 0, 0, pa.int64()
        crc = zlib.crc32

        def rows_of(full) -> list[tuple]:
            nonlocal number
            out = []
            for pieces in full:
                offset, sequence, total = 0, part * PER_PARTITION + number, sum(p[2] for p in pieces)
                to = padded(total, limits.tokens)
                for (key, ids), start, length, context in pieces:
                    out.append((key, start, length, crc(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, length - context, to))
                    offset += length
                number += 1
            return out

        def batch_of(out):
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names=schema.names)

        for batch, texts in by_bytes(batches, "_text", BATCH_BYTES):
            kind, part, out = batch.schema.field("doc_id").type, batch.column("_part")[0].as_py(), []
            heads = encode.lengths([heading(t) for t in texts])
            for key, parts, head in zip(batch.column("doc_id").to_pylist(), encode(texts), heads, strict=True):
                ids = b"".join([*(np.array(p, dtype="<u4").tobytes() for p in parts), end])
                out += rows_of(packer.put((key, ids), len(ids) // 4, max(1, head)))
            if out:
                yield batch_of(out)
        if out := rows_of(packer.finish()):
            yield batch_of(out)

    out = rows.mapInArrow(pack, schema)
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)
