"""Exact repeats of ``LENGTH`` bytes, by a distributed merge sort of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a
smaller id, or before in the same document.

Sampling. In every window of ``LENGTH`` bytes the leftmost ``GRAM``-byte string of smallest hash is
the window's anchor. It depends on the window's bytes alone, so equal windows have their anchor at
the same place, and all windows around one anchor form one stretch of text. Sorting the stretches
by their bytes from the anchor on (the suffixes that start at anchors, with their left context)
brings all equal windows together; about one suffix in 35 is needed.

    anchors   documents -> anchor hashes, packed by hash range; hashes met twice are repeated
    runs      repeated anchors x documents -> sorted runs of stretches, equal ones collapsed,
              front-coded: shared prefix length and the rest of the bytes
    merge     the runs of a hash range meet in one group: a loser tree over the runs gives the sorted
              order and the shared prefix with the predecessor without comparing known prefixes again
    spans     neighbours in that order -> repeated windows -> byte ranges per document
    texts     ranges x documents -> remaining bytes

Equal stretches of one task collapse before they are sent, and equal hashes of one task are sent once, so
a passage that a third of all documents share costs an entry per task. The stretches of a hot anchor
(one line between ever different neighbours) are cut into blocks of ``BLOCK`` windows, ordered and spread
by the bytes that all windows of a block share. An anchor is hot from ``HOT`` occurrences on, or from a
``1 / HOT_HASHES`` of all bytes; so there are no more than ``HOT_HASHES`` hot hashes, which are the only
ones that are broadcast.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; a
row that repeats another row's id and text is the same document and gets the same result; different
texts of one id are documents that follow each other; rows without id are the last of all documents; columns besides id and text are kept as they
are under ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from . import text as t
from .workers import release, ship

LENGTH = 100
GRAM = 32
BLOCK = 8
HOT = 20_000
HOT_HASHES = 4_000_000
#: Bytes of text per hash range of anchors, anchors per message, stretches per sorted run and per merge.
RANGE_BYTES = 8 << 20
FLUSH = 1 << 18
RUN = 40_000
MERGE = 60_000
#: Bytes of text looked at together; the hashes of a piece take about a hundred bytes for each of them.
PIECE_BYTES = 1 << 19
END = b"\xff"
PREFIX = 4
LAST = np.iinfo(np.int64).max


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of every text: hash, text number, anchor, first and last window start (piece offsets)."""
    n, width = len(data), length - gram + 1
    none = np.empty(0, dtype=np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none
    up, down = t.powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = t.mix((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
    low, span = h, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
    valid = np.zeros(n - length + 2, dtype=np.int8)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    new[offsets[long]] = True
    new &= valid
    first = np.flatnonzero(new)
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    last[-1:] = len(low) - 1
    text = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(last, offsets[text + 1] - length)
    value = low[first]
    anchor = first + width - 1
    # Entered at the right end, or else the leftmost of the window.
    found = (h[anchor] == value) & (first > 0) & (low[np.maximum(first - 1, 0)] > value) & ~np.isin(first, offsets[long])
    look = np.flatnonzero(~found)
    for a in range(0, len(look), 1 << 14):
        part = look[a : a + (1 << 14)]
        inside = h[first[part][:, None] + np.arange(width)] == value[part][:, None]
        anchor[part] = first[part] + inside.argmax(axis=1)
    # Smallest hashes crowd at the low end; mixed again they are even, as the ranges need.
    return t.mix(value ^ t.BASE), text, anchor, first, last


def _anchors(n_ranges: int, length: int, gram: int) -> Callable:
    """``(range, hash, doc, at, count)``: packed anchors.

    Anchors of one hash that meet in a task are one entry with their count; the others of them are
    repeated for certain and travel without a hash, in a range of their task's choice.
    """

    def packed(parts: list, number: int) -> Iterator[pa.RecordBatch]:
        value, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(value, kind="stable")
        value, doc, at = value[order], doc[order], at[order].astype(np.int32)
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        count = np.diff(np.append(start, len(value))).astype(np.int32)
        other = np.ones(len(value), dtype=bool)
        other[start] = False
        rows = [(number % n_ranges, b"", doc[other].tobytes(), at[other].tobytes(), b"")] if other.any() else []
        value, doc, at = value[start], doc[start], at[start]
        cut = np.searchsorted(_range(value, n_ranges), np.arange(n_ranges + 1))
        for r in range(n_ranges):
            own = np.arange(cut[r], cut[r + 1])
            if len(own):
                own = own[np.argsort(doc[own], kind="stable")]
                rows.append((r, value[own].tobytes(), doc[own].tobytes(), at[own].tobytes(), count[own].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["range", "hash", "doc", "at", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, 0
        for piece in t.pieces(batches, "text", PIECE_BYTES):
            data, offsets = t.flat(piece.column("text"))
            value, text, anchor, _, _ = stretches(data, offsets, length, gram)
            ids = piece.column("doc").to_numpy(zero_copy_only=False)
            if len(value):
                parts.append((value, ids[text], anchor - offsets[text]))
                held += len(value)
                number = int(value[0] % np.uint64(1 << 31))
            if held >= FLUSH:
                yield from packed(parts, number)
                parts, held = [], 0
        if held:
            yield from packed(parts, number)

    return run


def _range(value: np.ndarray, n: int) -> np.ndarray:
    """Even ranges of 64-bit hashes, in order."""
    return ((value >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _repeated(hot: int) -> Callable:
    """``(doc, marks)`` with the anchors of a hash range that occur at least twice, and a row of hot hashes."""

    def run(rows: pa.Table) -> pa.Table:
        hashed = [bool(h) for h in rows.column("hash").to_pylist()]
        joined = lambda name, kind, keep: np.frombuffer(
            b"".join(x for x, k in zip(rows.column(name).to_pylist(), hashed, strict=True) if k == keep), dtype=kind
        )
        value, count = joined("hash", np.uint64, True), joined("count", np.int32, True)
        doc, at = joined("doc", np.int64, True), joined("at", np.int32, True)
        order = np.argsort(value)
        ordered = value[order]
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(value) else np.empty(0, dtype=np.int64)
        total = np.add.reduceat(count[order].astype(np.int64), start) if len(value) else start
        sizes = np.diff(np.append(start, len(ordered)))
        take = order[np.repeat(total, sizes) > 1]
        doc = np.concatenate([doc[take], joined("doc", np.int64, False)])
        at = np.concatenate([at[take], joined("at", np.int32, False)])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, dtype=np.int64)
        marks = t.list_array(at, np.append(bounds, len(doc)), pa.int32())
        heavy = ordered[start][total >= hot]
        found = pa.table(
            {"doc": pa.array(doc[bounds], pa.int64()), "marks": marks, "hot": pa.nulls(len(bounds), pa.list_(pa.int64()))}
        )
        if not len(heavy):
            return found
        own = {"doc": [None], "marks": [None], "hot": [t.signed(heavy).tolist()]}
        return pa.concat_tables([found, pa.table(own, schema=found.schema)])

    return run


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix of every key with the one before it, and the rests in one string."""
    width = max(map(len, keys))
    table = np.array(keys, dtype=f"S{width}").view(np.uint8).reshape(len(keys), width)
    shared = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        shared[1:] = (table[1:] != table[:-1]).argmax(axis=1)
    return shared, b"".join([k[s:] for k, s in zip(keys, shared.tolist(), strict=True)])


def _runs(n_ranges: int, hot_hashes, length: int, gram: int) -> Callable:
    """``(range, shared, size, rest, count, doc, at)``: front-coded sorted runs of stretches, packed."""

    def packed(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        keys = sorted(found)
        head = np.array([int.from_bytes(k[:PREFIX], "big") for k in keys], dtype=np.uint64)
        cut = np.searchsorted((head * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64), np.arange(n_ranges + 1))
        rows = []
        for r in range(n_ranges):
            own = keys[cut[r] : cut[r + 1]]
            if own:
                shared, rest = front_coded(own)
                places = [found[k] for k in own]
                flat = np.array([x for p in places for x in p], dtype=np.int64).reshape(-1, 2)
                rows.append(
                    (
                        r,
                        shared.tobytes(),
                        np.array([len(k) for k in own], dtype=np.uint8).tobytes(),
                        rest,
                        np.array([len(p) for p in places], dtype=np.int32).tobytes(),
                        flat[:, 0].tobytes(),
                        flat[:, 1].astype(np.int32).tobytes(),
                    )
                )
        columns = list(zip(*rows, strict=True))
        names = ["range", "shared", "size", "rest", "count", "doc", "at"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        for piece in t.pieces(batches, "text", PIECE_BYTES):
            data, offsets = t.flat(piece.column("text"))
            value, text, anchor, first, last = stretches(data, offsets, length, gram)
            ids = piece.column("doc").to_numpy(zero_copy_only=False)
            marked, of = t.flat_list(piece.column("marks"))
            marked = np.sort(marked + offsets[of])
            at = np.searchsorted(marked, anchor)
            at[at == len(marked)] = 0
            wanted = np.flatnonzero(marked[at] == anchor) if len(marked) else at[:0]
            hot = np.isin(value[wanted], hot_hashes.value)
            raw = data.tobytes()
            heads = (value[wanted] >> np.uint64(32)).astype(">u4").tobytes()
            rows = zip(
                ids[text[wanted]].tolist(), offsets[text[wanted]].tolist(), anchor[wanted].tolist(),
                first[wanted].tolist(), last[wanted].tolist(), hot.tolist(), strict=True,
            )
            for i, (doc, base, x, s, e, is_hot) in enumerate(rows):
                head = heads[PREFIX * i : PREFIX * i + PREFIX]
                if not is_hot:
                    key = head + raw[x : e + length] + END + raw[s:x][::-1] + END
                    found.setdefault(key, []).append((doc, x - base))
                    continue
                for d in range((x - e) // BLOCK, (x - s) // BLOCK + 1):
                    # Windows that start d * BLOCK .. d * BLOCK + BLOCK - 1 bytes before the anchor.
                    low, high = max(x - e, d * BLOCK), min(x - s, d * BLOCK + BLOCK - 1)
                    common = raw[x - d * BLOCK : x - d * BLOCK - BLOCK + 1 + length]
                    key = _head(common, d) + raw[x : x - low + length] + END + raw[x - high : x][::-1] + END
                    found.setdefault(key, []).append((doc, x - base))
            if len(found) >= RUN:
                yield from packed(found)
                found = {}
        if found:
            yield from packed(found)

    return run


def _head(common: bytes, block: int) -> bytes:
    """Four bytes of a hash of the bytes that all windows of a block share."""
    value = int.from_bytes(common, "little") % 0x1FFFFFFFFFFFFFFF * (2 * block + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return (value >> 32).to_bytes(PREFIX, "big")


class Run:
    """A front-coded sorted run, read key by key; ``shared`` is the prefix shared with the last key."""

    __slots__ = ("shareds", "sizes", "rest", "counts", "docs", "ats", "i", "offset", "place", "key", "shared", "places")

    def __init__(self, shared: bytes, size: bytes, rest: bytes, count: bytes, doc: bytes, at: bytes):
        self.shareds, self.sizes, self.rest = shared, size, rest
        self.counts = np.frombuffer(count, dtype=np.int32).tolist()
        self.docs, self.ats = np.frombuffer(doc, dtype=np.int64), np.frombuffer(at, dtype=np.int32)
        self.i = self.offset = self.place = 0
        self.key, self.shared, self.places = b"", 0, (0, 0)
        self.next()

    def next(self) -> None:
        i = self.i
        if i == len(self.shareds):
            self.key, self.shared = _AFTER_ALL, 0
            return
        shared = self.shareds[i]
        n = self.sizes[i] - shared
        self.key = self.key[:shared] + self.rest[self.offset : self.offset + n]
        self.shared = shared
        self.offset += n
        self.places = (self.place, self.place + self.counts[i])
        self.place = self.places[1]
        self.i = i + 1


_AFTER_ALL = END * 256


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, Run, tuple[int, int]]]:
    """All keys in order with the prefix shared with the key before, by a loser tree.

    Every node keeps a loser and the prefix it shares with the last winner. The next key of the
    winning run comes with its shared prefix from the front coding. In a game the longer shared
    prefix wins without a look at the bytes; only equal ones compare, from that byte on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    players: list[Run | None] = [*runs, *[None] * (n - len(runs))]
    shared = [r.shared if r else 0 for r in players]
    keys = [r.key if r else _AFTER_ALL for r in players]
    losers = [0] * n

    def game(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        x, y = keys[a], keys[b]
        if x == y:
            first, second = (a, b) if a < b else (b, a)
            shared[second] = len(x)
            return first, second
        m = min(len(x), len(y)) - p
        differing = int.from_bytes(x[p : p + m], "big") ^ int.from_bytes(y[p : p + m], "big")
        same = p + m - (differing.bit_length() + 7) // 8
        first, second = (a, b) if x < y else (b, a)
        shared[second] = same
        return first, second

    winners = list(range(n))
    level = winners
    size = n
    while size > 1:
        size //= 2
        above = []
        for j in range(size):
            first, second = game(level[2 * j], level[2 * j + 1])
            losers[size + j] = second
            above.append(first)
        level = above
    top = level[0]
    while keys[top] is not _AFTER_ALL:
        run = players[top]
        yield keys[top], shared[top], run, run.places
        run.next()
        keys[top], shared[top] = run.key, run.shared
        node = (n + top) // 2
        while node:
            first, second = game(top, losers[node])
            losers[node] = second
            top = first
            node //= 2


def _windows(group: list, length: int, out: list) -> None:
    """Repeated windows among stretches ``(key, prefix shared with a neighbour, first place)``."""
    first: dict[tuple[int, bytes, bytes], tuple[int, int]] = {}
    seen = []
    for key, near, place in group:
        cut = key.index(END, PREFIX)
        right, left = key[PREFIX:cut], key[cut + 1 : -1]
        # A neighbour in the order shares the longest prefix, so nearer windows have no equal.
        low = max(length - len(right), length - (near - PREFIX))
        for d in range(low, len(left) + 1):
            window = (d, right[: length - d], left[:d])
            old = first.get(window)
            if old is None or place < old:
                first[window] = place
        seen.append((low, right, left, place))
    for low, right, left, place in seen:
        begin = None
        for d in range(low, len(left) + 2):
            gone = d <= len(left) and first[(d, right[: length - d], left[:d])] != place
            if gone and begin is None:
                begin = d
            elif not gone and begin is not None:
                out.append((place[0], place[1] - d + 1, place[1] - begin + length))
                begin = None


def _merger(length: int, gram: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        names = ("shared", "size", "rest", "count", "doc", "at")
        runs = [Run(*x) for x in zip(*(rows.column(n).to_pylist() for n in names), strict=True)]
        spans: list[tuple[int, int, int]] = []
        whole: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        # Of the stretches around one gram: key, shared prefixes with both neighbours, first place.
        group: list[list] = []
        key, parts = b"", []

        def close_key() -> None:
            if not parts:
                return
            docs = np.concatenate([r.docs[a:b] for r, (a, b) in parts])
            ats = np.concatenate([r.ats[a:b] for r, (a, b) in parts])
            place = (int(docs.min()), 0)
            place = (place[0], int(ats[docs == place[0]].min()))
            others = (docs != place[0]) | (ats != place[1])
            if others.any():
                cut = key.index(END, PREFIX)
                whole.append((docs[others], ats[others], len(key) - cut - 2, cut - PREFIX))
            group[-1][2] = place

        def close_group() -> None:
            if len(group) > 1:
                near = [(k, max(p, q), place) for (k, p, place, q) in group]
                _windows([x for x in near if length - (x[1] - PREFIX) <= len(x[0]) - x[0].index(END, PREFIX) - 2], length, spans)

        for k, shared, source, places in merged(runs):
            if k == key:
                parts.append((source, places))
                continue
            close_key()
            if group:
                group[-1][3] = shared
            if shared < PREFIX + gram:
                close_group()
                group = []
                shared = 0
            group.append([k, shared, None, 0])
            key, parts = k, [(source, places)]
        close_key()
        if group:
            group[-1][3] = 0
        close_group()
        doc = np.concatenate([*[w[0] for w in whole], np.array([s[0] for s in spans], dtype=np.int64)])
        begin = np.concatenate([*[w[1].astype(np.int64) - w[2] for w in whole], np.array([s[1] for s in spans], dtype=np.int64)])
        end = np.concatenate([*[w[1].astype(np.int64) + w[3] for w in whole], np.array([s[2] for s in spans], dtype=np.int64)])
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, dtype=np.int64)
        first = np.append(bounds, len(doc))
        return pa.table(
            {
                "doc": pa.array(doc[bounds], pa.int64()),
                "begins": t.list_array(begin.astype(np.int32), first, pa.int32()),
                "ends": t.list_array(end.astype(np.int32), first, pa.int32()),
            }
        )

    return run


def _remover(as_text: bool) -> Callable:
    """``(row, doc, n_bytes, spans, kept)``: ranges put together and taken out."""
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def joined(parts: list[bytes]) -> bytes | str:
        # A character that loses some of its bytes goes as a whole.
        return "".join([p.decode("utf-8", "ignore") for p in parts]) if as_text else b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in t.pieces(batches, "text", PIECE_BYTES):
            data, offsets = t.flat(piece.column("text"))
            raw = data.tobytes()
            kept, spans = [], []
            for d, (begins, ends) in enumerate(zip(piece.column("begins"), piece.column("ends"), strict=True)):
                a, b = int(offsets[d]), int(offsets[d + 1])
                if not begins.is_valid:
                    kept.append(joined([raw[a:b]]))
                    spans.append([])
                    continue
                begin = np.minimum(begins.values.to_numpy(), b - a).astype(np.int64)
                end = np.minimum(ends.values.to_numpy(), b - a).astype(np.int64)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.append(True, begin[1:] > end[:-1])
                begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                own = [(x, y) for x, y in zip(begin.tolist(), end.tolist(), strict=True) if x < y]
                edges = [0, *[e for s in own for e in s], b - a]
                kept.append(joined([raw[a + edges[i] : a + edges[i + 1]] for i in range(0, len(edges), 2)]))
                spans.append([{"from": x, "to": y} for x, y in own])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("row"),
                    piece.column("doc"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(spans, span),
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                ],
                ["row", "doc", "n_bytes", "spans", "kept"],
            )

    return run


def _numbers(texts: DataFrame) -> DataFrame | None:
    """``(doc, version, own)``: numbers in the order of ids, if an id stands for several texts."""
    versions = texts.select("doc", F.xxhash64("text").alias("version")).distinct()
    if versions.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return None
    ordered = versions.repartitionByRange("doc", "version").sortWithinPartitions("doc", "version")
    return materialise(ordered.withColumn("own", F.monotonically_increasing_id()), "numbers")


def _renumbered(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    if numbers is None:
        return rows
    joined = rows.withColumn("version", F.xxhash64("text")).join(numbers, ["doc", "version"])
    return joined.withColumn("doc", F.col("own")).drop("version", "own")


def repeated_spans(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    as_text: bool = False,
) -> DataFrame:
    """``(row, doc, n_bytes, spans, kept)`` per document row.

    ``spans`` are the maximal byte ranges ``(from, to)`` to remove, ``kept`` the other bytes, ``row``
    a struct of the other columns. With ``as_text``, ``kept`` is a text, without the characters that lose
    some of their bytes.
    """
    if not BLOCK < gram <= length - BLOCK or length > 120:
        raise ValueError(f"gram must lie between {BLOCK + 1} and length - {BLOCK}, length must not exceed 120")
    spark = documents.sparkSession
    ship(spark)
    others = [F.col(f"`{c}`") for c in documents.columns if c not in (id_col, text_col)]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("boolean").alias("none"))
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keyed = F.coalesce("doc", F.lit(int(LAST)).cast("long")).alias("doc")
    texts = texts.select(keyed, "text")
    numbers = _numbers(texts)
    texts = _renumbered(texts, numbers)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-n_bytes // RANGE_BYTES))
    anchors = texts.mapInArrow(
        _anchors(n_ranges, length, gram), "range int, hash binary, doc binary, at binary, count binary"
    )
    repeated = _repeated(max(hot, n_bytes // HOT_HASHES))
    found = anchors.groupBy("range").applyInArrow(repeated, "doc long, marks array<int>, hot array<long>")
    found = materialise(found, "marks")
    del anchors
    release(spark)
    heavy = found.filter("hot IS NOT NULL").select(F.explode("hot").alias("hash")).toArrow()
    hot_hashes = spark.sparkContext.broadcast(heavy.column("hash").to_numpy().view(np.uint64))
    marks = found.filter("hot IS NULL")
    n_merges = max(1, -(-(marks.agg(F.sum(F.size("marks"))).first()[0] or 0) // MERGE))
    by_doc = marks.groupBy("doc").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    runs = texts.join(by_doc, "doc").mapInArrow(
        _runs(n_merges, hot_hashes, length, gram),
        "range int, shared binary, size binary, rest binary, count binary, doc binary, at binary",
    )
    spans = runs.groupBy("range").applyInArrow(
        _merger(length, gram), "doc long, begins array<int>, ends array<int>"
    )
    spans = materialise(spans, "spans")
    del runs
    release(spark)
    ranges = spans.groupBy("doc").agg(
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    whole = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    whole = whole.withColumn("doc", F.coalesce("id", F.lit(int(LAST)).cast("long")))
    joined = _renumbered(whole, numbers).join(ranges, "doc", "left").select("row", F.col("id").alias("doc"), "text", "begins", "ends")
    kind = documents.select(row.alias("row")).schema["row"].dataType.simpleString()
    what = "string" if as_text else "binary"
    return joined.mapInArrow(
        _remover(as_text), f"row {kind}, doc long, n_bytes long, spans array<struct<from:long,to:long>>, kept {what}"
    )
