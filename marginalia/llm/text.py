"""Words, shingles and hashes of many texts at once, computed on the bytes of an Arrow column.

A column of texts is one run of bytes with offsets. Word bounds, word hashes and shingle hashes are
array operations over that run, so no Python code runs per word. Work goes in pieces of about
``PIECE_BYTES`` (a longer text is a piece of its own), which bounds the memory of a task.

Hashes have 64 bits: a polynomial over the bytes modulo 2**64, finished by a bijective mixer. They
find candidates; whatever must be exact is confirmed on the words themselves or on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that belong to a word."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: ASCII digits, letters and every byte of a non-ASCII character; judged after lower-casing A-Z.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64, at least ``n`` of them."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    data = np.empty(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``limit`` bytes of text, and one text at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words(NamedTuple):
    """Words of a piece. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(column: pa.Array, kind: np.ndarray) -> Words:
    """Words of every text: longest runs of bytes of ``kind``, A-Z lower-cased."""
    raw, offsets = flat(column)
    data = _LOWER[raw]
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    begins[bounds] = inside[bounds]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(data, start, end, h, np.searchsorted(start, offsets).astype(np.int64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values; runs over a text's end are included (see ``whole``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = h[:n].copy()
    for j in range(1, k):
        total *= STEP
        total += h[j : j + n]
    return mix(total + np.uint64(k))


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """For each start of ``shingle_hashes``: do the ``k`` values lie in one text?"""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text[:n] == text[k - 1 :]


def member(values: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the values that stand in the sorted ``table``; ``bits`` is its ``quick_bits``."""
    slot = values >> np.uint64(64 - 20)
    maybe = np.flatnonzero(bits[slot])
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == values[maybe]] if len(table) else maybe[:0]


def quick_bits(table: np.ndarray) -> np.ndarray:
    """Which values of the top 20 bits occur in ``table``: a first test that fits a processor cache."""
    bits = np.zeros(1 << 20, dtype=bool)
    bits[table >> np.uint64(64 - 20)] = True
    return bits


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per text from values in order and their bounds."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after the other, and the row that each belongs to."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), lengths)
