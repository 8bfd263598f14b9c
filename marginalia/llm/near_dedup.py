"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch. A document is its set of distinct word shingles. The sketch has ``T`` bins. In round i every
shingle is hashed into one bin with a value; a bin keeps the smallest ``(round, value)``. Rounds
go on until no bin is empty: about ``1 + T ln T / n`` of them for n shingles. After ``T`` rounds,
round ``T + j`` puts all shingles into bin j, so every bin is filled after ``2 T`` rounds at the
latest. Two sketches agree in a bin with the probability of the Jaccard similarity, and the
number of agreeing bins is concentrated as for independent hash functions, at a fraction of their
cost for long texts.

Bands. ``BANDS`` bands of ``ROWS`` bins: two documents of similarity s share no band with
probability ``(1 - s**ROWS)**BANDS``, 3e-6 at s = 0.8.

Verification. Equal sets are one node (128 bits of set hash and the size). In a band's bucket not
all pairs are made: every member is compared with the smallest one, on whole sets. Buckets that then
lie in one component need no more. In the others, pairs that could join two components are ruled out by
the number of bins that agree (the sketch's concentration bound) and, exactly, by histograms of the
shingles over ``CELLS`` cells, whose intersection bounds that of the sets. What is left is compared on whole sets, with
``FACTOR``, then ``FACTOR`` times as many, further centres of its bucket, those that meet most others first, until no
bucket has a pair that could join two components. So a group of m copies costs about m comparisons,
and no link between components is lost.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; texts
of fewer words than a shingle are one shingle, the whole sequence; repeated rows get equal results;
a row without id is nobody's representative; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from . import text as t
from .components import components
from .workers import ship

WORDS = 5
SIMILARITY = 80
BANDS, ROWS = 24, 4
PIECE_BYTES = 1 << 20
#: By how much the number of centres of a bucket grows from round to round.
FACTOR = 16
#: Fewer of the bins than this agree with a probability below 1e-7 at a similarity of 0.8.
AGREEING = 54
CELLS = 64

_SEEDS = t.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * t.BASE)
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(found: t.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and their bounds.

    The sort key holds the text's number and the upper bits of the hash; whole hashes decide what is
    equal.
    """
    n_texts = len(found.first) - 1
    hashes, text = t.shingle_hashes(found.hash, k), found.text_of
    if len(hashes):
        inside = text[: len(hashes)] == text[k - 1 :]
        hashes, text = hashes[inside], text[: len(hashes)][inside]
    else:
        text = text[:0]
    short = np.flatnonzero((np.diff(found.first) > 0) & (np.diff(found.first) < k))
    if len(short):
        own = [t.shingle_hashes(found.hash[found.first[d] : found.first[d + 1]], int(found.first[d + 1] - found.first[d]))[0] for d in short]
        hashes, text = np.concatenate([hashes, np.array(own, dtype=np.uint64)]), np.concatenate([text, short])
    bits = max(1, int(n_texts).bit_length())
    order = np.argsort((text.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def sketches(hashes: np.ndarray, first: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Sketch of every set: one row of ``bins`` values; empty sets keep the largest value."""
    n_sets = len(first) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n_sets * bins, empty, dtype=np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(first))
    for i in range(2 * bins):
        if not len(hashes):
            break
        drawn = t.mix(hashes ^ _SEEDS[i])
        value = (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        if i < bins:
            slot = ((drawn >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            slot = i - bins
        np.minimum.at(sketch, owner * bins + slot, value)
        left = (sketch.reshape(n_sets, bins) == empty).any(axis=1)[owner]
        hashes, owner = hashes[left], owner[left]
    return sketch.reshape(n_sets, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` bins; equal bins in different bands have different hashes."""
    cut = sketch.reshape(len(sketch), BANDS, ROWS)
    keys = np.zeros((len(sketch), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = t.mix(keys * t.STEP + cut[:, :, r])
    return keys


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def _sketcher(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in t.pieces(batches, "text", PIECE_BYTES):
            hashes, first = shingle_sets(t.words(piece.column("text"), t.NOT_BLANK), k)
            n = np.diff(first)
            sketch = sketches(hashes, first)
            some = n > 0
            bound = np.concatenate([[0], np.cumsum(some)])
            bands = t.list_array(t.signed(band_keys(sketch)[some].ravel()), bound * BANDS, pa.int64())
            low = (sketch[some] & np.uint64(0xFF)).astype(np.uint8).view(np.int8).ravel()
            bins = t.list_array(low, bound * BANDS * ROWS, pa.int8())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc"),
                    pa.array(n, pa.int64()),
                    pa.array(t.signed(_summed(t.mix(hashes), first))),
                    pa.array(t.signed(_summed(t.mix(hashes ^ _OTHER), first))),
                    bands,
                    bins,
                ],
                ["doc", "n", "s1", "s2", "bands", "bins"],
            )

    return run


def _set_maker(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in t.pieces(batches, "text", PIECE_BYTES):
            hashes, first = shingle_sets(t.words(piece.column("text"), t.NOT_BLANK), k)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), t.list_array(t.signed(hashes), first, pa.int64())], ["doc", "set"]
            )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b, ...)`` whose whole sets are similar enough."""
    right = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    both = right.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(100 * shared >= similarity * union).drop("set_a", "set_b")


def _still_mixed(members: DataFrame) -> DataFrame:
    """The rows of the buckets whose members lie in several components, with ``m``, their number."""
    ends = members.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")
    )
    return members.drop("m").join(ends.filter("low != high").select("key", "m"), "key")


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(rep, counts)``: how many shingles of a set fall into each of ``CELLS`` cells."""
    for batch in batches:
        values, of = t.flat_list(batch.column("set"))
        cell = (values.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)
        counts = np.bincount(of * CELLS + cell, minlength=batch.num_rows * CELLS)
        first = np.arange(batch.num_rows + 1) * CELLS
        yield pa.RecordBatch.from_arrays([batch.column("doc"), t.list_array(counts, first, pa.int32())], ["rep", "counts"])


def _links(shared: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``(rep, component)`` of all members of the buckets ``shared(key, band, rep, n)``."""
    fits = 100 * F.least("n", "n_a") >= similarity * F.greatest("n", "n_a")
    centres = shared.groupBy("key").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("n").alias("n_a"))).alias("c"))
    pairs = shared.join(centres.select("key", "c.*"), "key").filter(F.col("rep") != F.col("a")).filter(fits)
    links = _verified(pairs.select("a", F.col("rep").alias("b")).distinct(), sets, similarity)
    found = components(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).withColumnRenamed("node", "rep")
    members = shared.select("rep").distinct().join(found, "rep", "left")
    labels = materialise(members.withColumn("component", F.coalesce("component", "rep")), "labels")
    mixed = materialise(_still_mixed(shared.join(labels, "rep")), "mixed-buckets")
    if mixed.isEmpty():
        return labels
    # Sets that meet many others are tried first: they are the ones with the fewest changes.
    met_by = mixed.groupBy("rep").agg(F.sum("m").alias("met"))
    own = sets.join(met_by.select(F.col("rep").alias("doc")), "doc", "left_semi")
    about = own.mapInArrow(_histograms, "rep long, counts array<int>").join(met_by, "rep")
    about = about.join(nodes.select("rep", "bands", "bins"), "rep")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("met"), "rep"))
    ranked = mixed.join(about, "rep").withColumn("rank", rank)
    opened, done = materialise(ranked, "open-buckets"), 0
    while not opened.isEmpty():
        last = FACTOR * (done + 1)
        first = opened.filter(F.col("rank") <= last).select(
            "key",
            F.col("rep").alias("a"),
            F.col("n").alias("n_a"),
            F.col("counts").alias("counts_a"),
            F.col("rank").alias("rank_a"),
            F.col("bands").alias("bands_a"),
            F.col("bins").alias("bins_a"),
            F.col("component").alias("v"),
        )
        at_first = F.array_position(F.zip_with("bands", "bands_a", lambda x, y: x == y), True) == F.col("band") + 1
        agreeing = F.size(F.filter(F.zip_with("bins", "bins_a", lambda x, y: x == y), lambda same: same))
        most = F.aggregate(F.zip_with("counts", "counts_a", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        enough = (100 + similarity) * most >= similarity * (F.col("n") + F.col("n_a"))
        met = opened.join(first, "key").filter("rank > rank_a AND component != v")
        met = met.filter(fits).filter(at_first).filter(agreeing >= AGREEING).filter(enough)
        pairs = met.select("a", F.col("rep").alias("b"), "v", F.col("component").alias("u"))
        moved = materialise(components(_verified(pairs, sets, similarity).select("u", "v")), "moved")
        moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        to = F.coalesce("to", "component")
        labels = materialise(labels.join(moved, "component", "left").select("rep", to.alias("component")), "labels")
        rest = opened.filter(F.col("rank") > last).join(moved, "component", "left")
        rest = rest.withColumn("component", to).drop("to")
        opened, done = materialise(_still_mixed(rest), "open-buckets"), last
    return labels


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """``(doc, n_shingles, component, kept)`` per document row.

    ``similarity`` is the least Jaccard similarity of a link in hundredths (0.8 and more are what the
    bands are made for), ``component`` the smallest id that links reach, the own one included.
    """
    if similarity < 80:
        raise ValueError("the bands are made for similarities of 80 hundredths and more")
    ship(documents.sparkSession)
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, n long, s1 long, s2 long, bands array<long>, bins array<tinyint>"
    drawn = materialise(texts.mapInArrow(_sketcher(words), schema), "sketches")
    same = ["n", "s1", "s2"]
    nodes = drawn.filter("n > 0 AND doc IS NOT NULL").groupBy(*same).agg(
        F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("bins").alias("bins")
    )
    nodes = materialise(nodes, "nodes")
    buckets = nodes.select(F.posexplode("bands").alias("band", "key"), "rep", "n")
    several = buckets.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    shared = materialise(buckets.join(several, "key"), "buckets")
    members = shared.select(F.col("rep").alias("doc")).distinct()
    sets = texts.join(members, "doc", "left_semi").mapInArrow(_set_maker(words), "doc long, set array<long>")
    labels = _links(shared, nodes, materialise(sets, "sets"), similarity)
    placed = drawn.select("doc", *same).join(nodes.select("rep", *same), same, "left")
    placed = placed.join(labels, "rep", "left")
    component = F.coalesce("component", "rep", "doc")
    return placed.select(
        "doc",
        F.col("n").alias("n_shingles"),
        component.alias("component"),
        F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"),
    )
