"""Benchmark decontamination as a prefix-filtered set join.

Every window of ``window`` consecutive words of a benchmark item is a set of word shingles tied to
its positions. A document contains the window only if it contains all of them, so one necessary
token is enough to find every candidate: with shingles ordered by rarity, the prefix of a window
is its rarest shingle. Rarity is the shingle's count over all documents.

    windows      one row per item window, with the hashes of its shingles
    frequencies  documents -> count of every benchmark shingle       (grouped, map-side combined)
    prefixes     windows  -> rarest shingle and its place in the window
    probes       documents -> places of prefix shingles, with the words around them
    hits         probes x prefixes on the shingle; length and positional bounds; exact words

Texts are never shuffled: the shingle tables sent to the tasks hold at most ``block`` hashes; a
larger benchmark is worked off in several blocks, each against all documents. A probe carries only
the words that the largest window could cover.

Defined results: null, empty and wordless texts have no words, no hits and are not contaminated; an
item of fewer words than the window is one window of its own length; items with equal windows all
count; repeated document rows give repeated result rows; an empty benchmark hits nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from . import text as t
from .workers import ship

WINDOW = 13
SHINGLE = 5
BLOCK = 500_000

_DOCUMENT = "doc long, version long, n_words long"
_PROBES = "probes array<struct<at:long,token:long,base:long,near:array<string>>>"
_WINDOWS = "item long, n int, words array<string>, hashes array<long>"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``(item, n, words, hashes)``: every window, its words and the hashes of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            rows = []
            for d, item in enumerate(piece.column("item").to_pylist()):
                a, b = int(found.first[d]), int(found.first[d + 1])
                size = min(window, b - a)
                width = min(shingle, size)
                spelled = [found.word(i) for i in range(a, b)]
                hashes = t.signed(t.shingle_hashes(found.hash[a:b], width)) if size else ()
                for s in range(b - a - size + 1 if size else 0):
                    rows.append((item, size, spelled[s : s + size], hashes[s : s + size - width + 1].tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)],
                ["item", "n", "words", "hashes"],
            )

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _WINDOWS)


def _tables(rows: pa.Table) -> dict[int, np.ndarray]:
    """Sorted hashes by the number of words of the shingle."""
    width, token = (rows.column(i).to_numpy() for i in range(2))
    return {int(k): np.sort(token[width == k].view(np.uint64)) for k in np.unique(width)}


def _found(piece_words: t.Words, width: int, table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the shingles that stand in ``table``."""
    hashes = t.shingle_hashes(piece_words.hash, width)
    at = t.member(hashes, table, bits)
    at = at[t.whole(piece_words.first, width)[at]]
    return at, hashes[at]


def _counter(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        bits = {k: t.quick_bits(v) for k, v in tables.items()}
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            for width, table in tables.items():
                value, n = np.unique(_found(found, width, table, bits[width])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.signed(value)), pa.array(n)], ["token", "n"])

    return run


def _prober(shared, reach: int) -> Callable:
    """Per document its number of words and its probes: position, token, first word at hand, words."""
    probe = pa.struct([("at", pa.int64()), ("token", pa.int64()), ("base", pa.int64()), ("near", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        bits = {k: t.quick_bits(v) for k, v in tables.items()}
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            probes: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            for width, table in tables.items():
                at, hashes = _found(found, width, table, bits[width])
                text = np.searchsorted(found.first, at, side="right") - 1
                for d, i, h in zip(text.tolist(), at.tolist(), t.signed(hashes).tolist(), strict=True):
                    a, b = int(found.first[d]), int(found.first[d + 1])
                    low, high = max(a, i - reach + width), min(b, i + reach)
                    near = [found.word(j) for j in range(low, high)]
                    probes[d].append({"at": i - a, "token": h, "base": low - a, "near": near})
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc"),
                    piece.column("version"),
                    pa.array(np.diff(found.first), pa.int64()),
                    pa.array(probes, pa.list_(probe)),
                ],
                ["doc", "version", "n_words", "probes"],
            )

    return run


def _covered(spans: Column) -> Column:
    """Number of positions in the union of ``(from, to)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], acc["to"]))).cast("long").alias("n"),
        F.greatest(acc["to"], s["to"]).cast("long").alias("to"),
    )
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def contamination(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc, n_words, spans, items)`` per document row.

    ``spans`` are the distinct ``(from, to)`` word ranges of windows that occur, ``items`` the
    distinct items they belong to. ``n_hit`` counts the words inside any of the spans.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(F.col(text_col)).alias("version"),
        F.col(text_col).alias("text"),
    )
    windows = materialise(item_windows(items, item_col, item_text_col, window, shingle), "item-windows")
    width = F.least(F.col("n"), F.lit(shingle))
    tokens = windows.select(width.alias("width"), F.explode("hashes").alias("token")).distinct()
    n_blocks = max(1, -(-tokens.count() // block))
    part = F.pmod(F.xxhash64("token"), F.lit(n_blocks)).cast("int")

    def shared(wanted: DataFrame, number: int):
        return spark.sparkContext.broadcast(_tables(wanted.filter(part == number).select("width", "token").toArrow()))

    counts = [texts.mapInArrow(_counter(shared(tokens, i)), "token long, n long") for i in range(n_blocks)]
    frequency = reduce(DataFrame.unionByName, counts).groupBy("token").agg(F.sum("n").alias("n_in_corpus"))

    # A window with a shingle that no document has can't occur: it gets no prefix.
    placed = windows.groupBy("n", "words", "hashes").agg(F.collect_set("item").alias("items"))
    places = placed.select("n", "words", "items", F.posexplode("hashes").alias("offset", "token"))
    seen = F.coalesce("n_in_corpus", F.lit(0))
    ranked = places.join(frequency, "token", "left").groupBy("n", "words", "items").agg(
        F.min(seen).alias("rarest"), F.min_by(F.struct("offset", "token"), F.struct(seen, F.col("offset"))).alias("p")
    )
    prefixes = ranked.filter("rarest > 0").select("n", "words", "items", "p.offset", "p.token")
    prefixes = materialise(prefixes, "prefixes")
    wanted = prefixes.select(width.alias("width"), "token").distinct()

    passes = [texts.mapInArrow(_prober(shared(wanted, i), window), f"{_DOCUMENT}, {_PROBES}") for i in range(n_blocks)]
    probed = [materialise(p, "probes") for p in passes]
    probes = reduce(DataFrame.unionByName, probed).select("doc", "version", F.explode("probes").alias("probe"))
    met = probes.select("doc", "version", "probe.*").join(prefixes, "token")
    start = F.col("at") - F.col("offset")
    bounded = met.filter((start >= F.col("base")) & (start + F.col("n") <= F.col("base") + F.size("near")))
    exact = bounded.filter(F.slice("near", (start - F.col("base") + 1).cast("int"), F.col("n")) == F.col("words"))
    hits = exact.groupBy("doc", "version").agg(
        F.collect_set(F.struct(start.alias("from"), (start + F.col("n")).alias("to"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    found = hits.withColumnsRenamed({"doc": "hit_doc", "version": "hit_version"})
    same = F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("version") == F.col("hit_version"))
    return (
        probed[0]
        .select("doc", "version", "n_words")
        .join(found, same, "left")
        .select(
            "doc",
            "n_words",
            F.coalesce("spans", F.array().cast("array<struct<from:long,to:long>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        )
        .withColumn("n_hit", _covered(F.col("spans")))
    )
