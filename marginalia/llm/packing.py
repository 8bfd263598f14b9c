"""Vector bin packing of documents into training sequences.

A sequence has limits on tokens, segments and loss-bearing tokens. A document is a vector of the
same three amounts, and the next one for a sequence is that of the largest dot product with what
is left of the limits (each as a share of its limit): the document that is large where there is
room. Documents may be cut, so when nothing fits, a piece that fills the sequence is cut off.

Parts of a document that fill sequences on their own need no search. The rest goes through a pool
of ``POOL`` documents, so a task's memory is bounded, and no shuffle is needed: each task packs what it reads.
What is left at the end of a task, less than a sequence, is laid out in sequences of lengths that are powers of two, which
need no padding; so are sequences that other limits keep short.

Defined results: null and empty texts are the end id alone; every id lies in exactly one piece; rows
that repeat an id are packed as documents of their own; other columns are ignored. Sequence ids are
unique and depend on the partitions of the input; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import text as t
from .wordids import WordIds
from .workers import ship

POOL = 1024
SEGMENTS = 256


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = SEGMENTS
    loss: int = 4096


class Piece(NamedTuple):
    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    loss_from: int  # first id of the document that bears loss

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(ids=self.ids[n:], start=self.start + n)


class Packer:
    """Takes documents one by one and gives finished sequences, lists of pieces."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.size = limits, pool
        self.pool: list[Piece] = []
        self.demand = np.zeros((2 * pool + 2, 3))  # shares of the limits, by place in the pool

    def _put(self, place: int, piece: Piece) -> None:
        self.demand[place] = (len(piece.ids), 1, piece.loss)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens = self.limits.tokens
        while len(piece.ids) >= tokens and piece.cut(tokens)[0].loss <= self.limits.loss:
            full, piece = piece.cut(tokens)
            yield [full]
        if len(piece.ids):
            self._put(len(self.pool), piece)
            self.pool.append(piece)
        while len(self.pool) >= self.size:
            yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self._fill()

    def _take(self, place: int) -> Piece:
        piece, last = self.pool[place], self.pool.pop()
        if place < len(self.pool):
            self.pool[place] = last
            self.demand[place] = self.demand[len(self.pool)]
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        limits = np.array(self.limits, dtype=float)
        left, sequence = limits.copy(), []
        while self.pool and left[0] > 0 and left[1] > 0:
            demand = self.demand[: len(self.pool)]
            score = demand @ (left / (limits * limits))
            fits = (demand <= left).all(axis=1)
            if left[1] == 1:  # the last segment should fill the sequence
                fits &= demand[:, 0] == left[0]
            if fits.any():
                piece = self._take(int(np.where(fits, score, -1.0).argmax()))
            else:
                place = int(score.argmax())
                piece = self.pool[place]
                n = self._room(piece, left)
                if n == 0:
                    place, n = self._any_room(left)
                    if n == 0:
                        break
                    piece = self.pool[place]
                if n == len(piece.ids):
                    piece = self._take(place)
                else:
                    piece, rest = piece.cut(n)
                    self.pool[place] = rest
                    self._put(place, rest)
            sequence.append(piece)
            left -= (len(piece.ids), 1, piece.loss)
        yield from _powers_of_two(sequence, int(limits[0] - left[0]), self.limits.tokens)

    def _room(self, piece: Piece, left: np.ndarray) -> int:
        """How many ids of the piece go in: all tokens without loss, then as many as may bear loss."""
        free = max(0, min(len(piece.ids), piece.loss_from - piece.start))
        return int(min(left[0], len(piece.ids), free + left[2]))

    def _any_room(self, left: np.ndarray) -> tuple[int, int]:
        rooms = [self._room(p, left) for p in self.pool]
        place = int(np.argmax(rooms))
        return place, rooms[place]


def _powers_of_two(sequence: list[Piece], n: int, tokens: int) -> Iterator[list[Piece]]:
    """The sequence itself if full, else sequences whose lengths are the powers of two that make up ``n``."""
    if n == tokens:
        yield sequence
        return
    rest = list(reversed(sequence))
    for bit in range(n.bit_length() - 1, -1, -1):
        room, own = n & (1 << bit), []
        while room:
            piece = rest.pop()
            if len(piece.ids) > room:
                piece, later = piece.cut(room)
                rest.append(later)
            own.append(piece)
            room -= len(piece.ids)
        if own:
            yield own


_COLUMNS = [
    ("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
]


def _pack(path: str, end_id: int, limits: Limits, with_ids: bool) -> Callable:
    def rows(sequences: Iterator[list[Piece]], base: int, counter: list[int]) -> list[tuple]:
        out = []
        for sequence in sequences:
            offset = 0
            for p in sequence:
                crc = zlib.crc32(np.ascontiguousarray(p.ids, dtype="<u4"))
                ids = p.ids.tolist() if with_ids else None
                out.append((p.doc, p.start, len(p.ids), crc, p.total, base + counter[0], offset, ids))
                offset += len(p.ids)
            counter[0] += 1
        return out

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _COLUMNS, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordIds(path), Packer(limits)
        base, counter = TaskContext.get().partitionId() << 36, [0]
        for piece in t.pieces(batches, "text"):
            texts = [x or "" for x in piece.column("text").to_pylist()]
            ids, first = encoder.encode(texts)
            starts = piece.column("loss_from").to_pylist()
            found = []
            for d, doc in enumerate(piece.column("doc").to_pylist()):
                own = np.append(ids[first[d] : first[d + 1]], np.int32(end_id))
                whole = Piece(doc, 0, own, len(own), max(0, starts[d] or 0))
                found += rows(packer.add(whole), base, counter)
            if found:
                yield batch(found)
        found = rows(packer.finish(), base, counter)
        if found:
            yield batch(found)

    return run


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
    end_id: int = 2,
    limits: Limits = Limits(),
    with_ids: bool = False,
) -> DataFrame:
    """``(doc, start, length, ids_crc32, doc_tokens, sequence, offset, ids)``, one row per piece.

    ``loss_from_col`` names a column with the number of a document's first ids that bear no loss
    (a prompt); without it all ids bear loss. ``ids`` is null unless ``with_ids``.
    """
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    if limits.tokens & (limits.tokens - 1):
        raise ValueError("the token limit must be a power of two")
    ship(documents.sparkSession)
    loss_from = F.col(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), loss_from.alias("loss_from")
    )
    return rows.mapInArrow(
        _pack(tokenizer_path, end_id, limits, with_ids),
        "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, ids array<int>",
    )
