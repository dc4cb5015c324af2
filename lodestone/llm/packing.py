"""Packing: vector bin packing of token pieces under simultaneous limits.

A sequence has three capacities: tokens, segments (pieces) and loss-bearing
tokens.  Documents are cut into full pieces first; what remains of each is
placed among a bounded number of open sequences: of those with room in every
dimension, the one whose free capacity has the largest dot product with the
piece's demand, both relative to the limits.  If none has room and no further
sequence may be opened, the piece is cut to fill the one with the largest
product.  At the end of a partition the open sequences are merged by cutting,
and a sequence that stays short is split at powers of two, where no padding is
needed.

Plain documents come without a loss mask: all ids but a document's first bear
loss, and the limit of loss-bearing tokens is that of tokens unless it is given,
so it decides nothing for them; the limits of tokens and segments do.

Each task packs its own partition: no shuffle, bounded memory, and a task that
runs again on another executor gives the same rows.  Padding is at most a few
tokens a partition.

Defined results: null and empty texts give the end id alone, one piece; repeated
rows and rows with a null doc_id are packed one by one; an empty table gives no
pieces; columns other than ``doc_id``, ``text`` and a loss mask are not read.  Every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed
from .tokens import CachedEncoder, default_tokenizer

#: A sequence attends to each of its segments apart, which bounds their number.
MAX_TOKENS, MAX_SEGMENTS, OPEN_SEQUENCES = 4096, 8, 64


class Piece:
    """Tokens [start, start + length) of a document.  ``bears`` says for each
    whether the loss counts it; ``None``: all but the document's first."""

    __slots__ = ("bears", "doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int, bears: np.ndarray | None = None) -> None:
        self.doc, self.start, self.ids, self.total, self.bears = doc, start, ids, total, bears

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return int(self.bears.sum()) if self.bears is not None else len(self) - (self.start == 0)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        b = self.bears
        return (
            Piece(self.doc, self.start, self.ids[: 4 * n], self.total, None if b is None else b[:n]),
            Piece(self.doc, self.start + n, self.ids[4 * n :], self.total, None if b is None else b[n:]),
        )

    def most(self, tokens: int, loss: int) -> int:
        """Tokens of the longest head within both limits."""
        if self.bears is None:
            return min(len(self), tokens, loss + (self.start == 0))
        return min(len(self), tokens, int(np.searchsorted(np.cumsum(self.bears), loss, side="right")))


class Packer:
    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, open_sequences: int = OPEN_SEQUENCES) -> None:
        self.limits = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], np.int64)
        if self.limits.min() < 1:
            raise ValueError("limits are positive")
        self.free = np.zeros((open_sequences, 3), np.int64)
        self.bins: list[list[Piece] | None] = [None] * open_sequences
        self.done: list[list[Piece]] = []

    def _place(self, k: int, piece: Piece, loss: int) -> None:
        self.bins[k].append(piece)
        free = self.free[k]
        free -= (len(piece), 1, loss)
        if not free[0] or not free[1]:
            self._close(k)

    def _close(self, k: int) -> None:
        used = self.limits[0] - self.free[k, 0]
        self.done += [self.bins[k]] if not self.free[k, 0] or not used & (used - 1) else self._powers(self.bins[k])
        self.bins[k] = None
        self.free[k] = 0

    def _powers(self, pieces: list[Piece]) -> list[list[Piece]]:
        """The pieces as sequences whose sizes are powers of two."""
        left, out = sum(map(len, pieces)), []
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out.append([])
            while room:
                p = pieces.pop()
                if len(p) > room:
                    p, rest = p.cut(room)
                    pieces.append(rest)
                out[-1].append(p)
                room -= len(p)
        return out

    def add(self, piece: Piece) -> None:
        tokens, _, loss = self.limits
        while (n := piece.most(tokens, loss)) < len(piece) or len(piece) == tokens:
            head, piece = piece.cut(n)
            self.done += [[head]] if n == tokens or not n & (n - 1) else self._powers([head])
            if not len(piece):
                return
        while True:
            need = np.array([len(piece), 1, piece.loss], np.int64)
            score = (self.free / self.limits**2) @ need
            fits = (self.free >= need).all(axis=1)
            if fits.any():
                self._place(int(np.argmax(np.where(fits, score, -1.0))), piece, int(need[2]))
                return
            if None in self.bins:
                k = self.bins.index(None)
                self.bins[k], self.free[k] = [], self.limits
                self._place(k, piece, int(need[2]))
                return
            k = int(np.argmax(score))
            n = piece.most(int(self.free[k, 0]), int(self.free[k, 2]))
            if not n:  # nothing more fits there
                self._close(k)
                continue
            head, piece = piece.cut(n)
            self._place(k, head, head.loss)

    def take(self) -> list[list[Piece]]:
        done, self.done = self.done, []
        return done

    def finish(self) -> list[list[Piece]]:
        """Close all sequences: the emptiest are cut up to fill the fullest."""
        left = sorted((b for b in self.bins if b), key=lambda b: sum(map(len, b)))
        self.bins = [None] * len(self.bins)
        self.free[:] = 0
        kept, self.bins = self.bins, [None]
        self.free, frees = np.zeros((1, 3), np.int64), self.free
        for b in reversed(left):
            for p in b:
                self.add(p)
        if self.bins[0]:
            self._close(0)
        self.bins, self.free = kept, frees
        return self.take()


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False, loss: str | None = None, **limits) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), in sequences; ``with_ids``
    adds the piece's ids as an array column.  ``loss`` names an array<boolean>
    column: for each id of the document, the end id included, whether the loss
    counts it; null: all but the first."""
    tokenizer = tokenizer or default_tokenizer()
    fields = [(x, pa.int64()) for x in _NAMES] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer = CachedEncoder(tokenizer, end_id), Packer(**limits)
        number = TaskContext.get().partitionId() << 32

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in fields]
            for pieces in sequences:
                at = 0
                for p in pieces:
                    values = (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, number, at)
                    for column, v in zip(out, values, strict=False):
                        column.append(v)
                    if with_ids:
                        out[-1].append(np.frombuffer(p.ids, "<u4").astype(np.int32))
                    at += len(p)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)

        for batch in batches:
            for some in slices(batch):
                masks = some.column(2).to_pylist() if loss else [None] * some.num_rows
                for doc, ids, mask in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), masks, strict=True):
                    if mask is not None and len(mask) != len(ids) // 4:
                        raise ValueError(f"doc_id {doc}: {len(mask)} loss flags for {len(ids) // 4} ids")
                    packer.add(Piece(doc, 0, ids, len(ids) // 4, None if mask is None else np.array(mask, bool)))
                if packer.done:
                    yield rows(packer.take())
        yield rows(packer.finish())

    return docs.select(F.col("doc_id").cast("long"), "text", *([loss] if loss else [])).mapInArrow(trimmed(run), _PIECE + (", ids array<int>" if with_ids else ""))
