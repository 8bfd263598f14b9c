"""Toxicity by subword bags: averaged character n-gram embeddings under a linear softmax.

A word is the bag of its character n-grams (with marks for its ends), hashed into ``BUCKETS`` rows
of an embedding table. The vectors of a word's n-grams are averaged, the words of a window
of ``WINDOW`` words are averaged, and a linear softmax over (clean, toxic) sits on top; table and
softmax are trained jointly. A misspelling that was never seen shares most n-grams, and hence
most of its vector, with the word it stands for. A document is as toxic as its most toxic window; overlapping
windows cover the whole text, so a few words in a long text are not averaged away.

Training runs in numpy on the driver, on a bounded sample: per label the ``SAMPLE`` ids with the smallest
hash among documents of at most ``SAMPLE_BYTES`` bytes, and once more with a letter changed in many words. In
every round the most toxic window of each document stands for it, and random halves of the n-grams are left
out, so that no single one carries a word. For scoring, table and softmax collapse into one number per bucket, which is broadcast.

Defined results: null, empty and wordless texts get the score of an empty window (all averages zero);
without labels of both kinds every score is 0; repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as t
from .workers import ship

BUCKETS = 1 << 17
DEPTH = 8
GRAMS = (3, 4, 5)
WINDOW = 2
STEP = 1
SAMPLE = 1000
SAMPLE_BYTES = 8_000
ROUNDS = 12
BATCH = 64
RATE = 1.0
KEEP = 0.5
_OPEN, _CLOSE = 0x3C, 0x3E


class Model(NamedTuple):
    table: np.ndarray  # (BUCKETS, DEPTH)
    softmax: np.ndarray  # (DEPTH, 2)
    shift: np.ndarray  # (2,)

    def collapsed(self) -> tuple[np.ndarray, float]:
        """What every bucket adds to the difference of the two logits, and the constant."""
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0]), float(self.shift[1] - self.shift[0])


def subwords(found: t.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words in order, and the bounds of the words."""
    n_words = len(found.start)
    if not n_words:
        return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    size = found.end - found.start + 2
    bound = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(n_words), size)
    inner = np.arange(bound[-1]) - bound[word] - 1
    source = np.clip(found.start[word] + inner, 0, len(found.data) - 1)
    letters = found.data[source].astype(np.uint32)
    letters[bound[:-1]] = _OPEN
    letters[bound[1:] - 1] = _CLOSE
    words, hashes = [], []
    for n in GRAMS:
        if len(letters) < n:
            continue
        h = np.full(len(letters) - n + 1, n, dtype=np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= letters[j : len(letters) - n + 1 + j]
        inside = word[: len(h)] == word[n - 1 :]
        words.append(word[: len(h)][inside])
        hashes.append(h[inside] * np.uint32(0x9E3779B1))
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    buckets = (np.concatenate(hashes) >> np.uint32(32 - 17)).astype(np.int32)[order]
    return buckets, np.searchsorted(word[order], np.arange(n_words + 1))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds of overlapping windows over every text, and the text of each."""
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(count)), n)
    begin = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(begin + WINDOW, first[text + 1]), text


def word_values(value: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean over the n-grams of every word of a number per bucket."""
    if len(bounds) == 1:
        return np.empty(0)
    return np.add.reduceat(value[buckets], bounds[:-1]) / np.diff(bounds)


def window_logits(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[end] - total[begin]) / np.maximum(end - begin, 1)


def text_logits(found: t.Words, value: np.ndarray, shift: float) -> np.ndarray:
    """The largest window logit of every text."""
    n_texts = len(found.first) - 1
    begin, end, text = windows(found.first)
    logits = window_logits(word_values(value, *subwords(found)), begin, end)
    best = np.full(n_texts, -np.inf)
    np.maximum.at(best, text, logits)
    return np.where(np.isfinite(best), best, 0.0) + shift


def misspelt(text: str, draw: np.random.Generator, share: float = 0.4) -> str:
    """A letter dropped, doubled or swapped with the next one in a share of the longer words."""
    words = text.split(" ")
    for i in np.flatnonzero(draw.random(len(words)) < share):
        word = words[i]
        if len(word) > 4:
            at, kind = int(draw.integers(1, len(word) - 2)), draw.integers(3)
            middle = ("", word[at] * 2, word[at + 1] + word[at])[kind]
            words[i] = word[:at] + middle + word[at + (2 if kind == 2 else 1) :]
    return " ".join(words)


def _bags(texts: list[str], at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``subwords`` of many texts and the word bounds of the texts, some texts at a time to save memory."""
    buckets, grams, words = [], [], []
    for i in range(0, len(texts), at_once):
        found = t.words(pa.array(texts[i : i + at_once], pa.string()), t.ALPHANUMERIC)
        own, bounds = subwords(found)
        buckets.append(own)
        grams.append(np.diff(bounds))
        words.append(np.diff(found.first))
    zero = np.zeros(1, dtype=np.int64)
    ends = (np.cumsum(np.concatenate([zero, *x])) for x in (grams, words))
    return np.concatenate(buckets), *ends


def train(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Adagrad on the most toxic window of every text, in mini-batches."""
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.05, (BUCKETS, DEPTH)).astype(np.float32)
    softmax = draw.normal(0, 0.5, (DEPTH, 2)).astype(np.float32)
    shift = np.zeros(2, dtype=np.float32)
    square_table = np.full(BUCKETS, 1e-2, dtype=np.float32)
    square_softmax, square_shift = np.full_like(softmax, 1e-1), np.full_like(shift, 1e-1)
    texts, toxic = texts + [misspelt(x, draw) for x in texts], np.concatenate([toxic, toxic])
    buckets, bounds, first = _bags(texts)
    begin, end, text = windows(first)
    n_texts = len(texts)
    for turn in range(rounds):
        value = table @ (softmax[:, 1] - softmax[:, 0])
        logits = window_logits(word_values(value, buckets, bounds), begin, end)
        order = np.lexsort((logits, text))
        last = np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)
        best = np.full(n_texts, -1)
        best[text[order][last]] = order[last]
        chosen = best[best >= 0]
        clean = np.flatnonzero(toxic[text] == 0)
        extra = draw.choice(clean, min(len(clean), len(chosen) // 2), replace=False) if len(clean) else clean
        if turn < 2:  # before the table says anything, any window may stand for its text
            chosen = draw.permutation(len(text))[: 2 * n_texts]
        rows = draw.permutation(np.concatenate([chosen, extra]))
        for i in range(0, len(rows), BATCH):
            own = rows[i : i + BATCH]
            sizes = (end - begin)[own]
            word = np.repeat(begin[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of_word = np.repeat(np.arange(len(own)), sizes)
            grams = np.diff(bounds)[word]
            at = np.repeat(bounds[word], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
            weight = np.repeat(1.0 / (grams * sizes[of_word]), grams).astype(np.float32)
            row, bucket = np.repeat(of_word, grams), buckets[at]
            keep = draw.random(len(at)) < KEEP
            weight, row, bucket = weight[keep] / np.float32(KEEP), row[keep], bucket[keep]
            bag = np.zeros((len(own), DEPTH), dtype=np.float32)
            np.add.at(bag, row, table[bucket] * weight[:, None])
            z = bag @ softmax + shift
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), toxic[text[own]]] -= 1
            d_softmax, d_shift, d_bag = bag.T @ p, p.sum(axis=0), p @ softmax.T
            used, place = np.unique(bucket, return_inverse=True)
            d_table = np.zeros((len(used), DEPTH), dtype=np.float32)
            np.add.at(d_table, place, d_bag[row] * weight[:, None])
            square_table[used] += (d_table * d_table).sum(axis=1)
            table[used] -= np.float32(RATE) * d_table / np.sqrt(square_table[used])[:, None]
            square_softmax += d_softmax * d_softmax
            softmax -= np.float32(0.2) * d_softmax / np.sqrt(square_softmax)
            square_shift += d_shift * d_shift
            shift -= np.float32(0.2) * d_shift / np.sqrt(square_shift)
    return Model(table, softmax, shift)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model | None:
    """A model from at most ``sample`` documents of either label (1 toxic, 0 clean; others are ignored).

    Sizes and labels meet by id, without the texts; the texts of the chosen ids alone are read then.
    """
    sizes = documents.select(F.col(id_col).alias("id"), F.octet_length(text_col).alias("size"))
    fits = sizes.filter(F.col("size").between(1, SAMPLE_BYTES)).select("id")
    chosen = None
    for label in (0, 1):
        own = labels.filter(F.col(label_col) == label).select(F.col(id_col).alias("id")).distinct()
        found = fits.join(own, "id").distinct().withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
        found = found.select("id", F.lit(label).alias("label"))
        chosen = found if chosen is None else chosen.unionByName(found)
    # At most 2 * sample ids.
    ids = documents.sparkSession.createDataFrame(chosen.toArrow())
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.octet_length("text").between(1, SAMPLE_BYTES)
    )
    rows = texts.join(F.broadcast(ids), "id").dropDuplicates(["id", "text", "label"]).orderBy("label", "id", "text").toArrow()
    toxic = rows.column("label").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    return train(rows.column("text").to_pylist(), toxic.astype(np.int64))


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in t.pieces(batches, "text"):
            scores = np.zeros(piece.num_rows)
            if shared.value is not None:
                value, shift = shared.value
                logits = text_logits(t.words(piece.column("text"), t.ALPHANUMERIC), value, shift)
                scores = 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(scores)], ["doc", "score"])

    return run


def toxicity(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, score)`` per document row, the probability of being toxic."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model.collapsed() if model else None)
    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc long, score double")
