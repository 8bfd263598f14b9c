"""Quality by Bradley-Terry ranking: scores learnt from pairs of which one document is preferred.

A document is described by the shape of its whole text: how often a byte of one class follows one of another
(upper, lower, digit, blank, line end, sentence mark, other symbol, non-ASCII), how often a word repeats one of the two
before it, the lengths of words and lines. Of a pair, document ``i`` is preferred to ``j`` with probability
``sigmoid(w . (x_i - x_j))``; ``w`` minimises the logistic loss of the feature differences plus a ridge, by Newton
steps. Pairs are drawn between documents of either label. A score says how a document ranks; the threshold is the quantile of the scores that leaves as large a share of
the labelled documents below it as have label 0. Scores are given as the probability of being
preferred to a document at the threshold, shifted so that the threshold lies at ``CUT``.

Learning takes every labelled document. Their features are dealt to groups by a hash of the id, about ``GROUP`` documents of
the more frequent label each; where the rarer label would be thin, its documents go to several groups, ``LEAST`` to a group.
Pairs are drawn within a group, and every document takes part. Each Newton step is a Spark job whose tasks add up gradient and curvature of their
groups; the threshold is narrowed down by counts over all scores. A group's sums depend on its rows alone and are added as whole multiples of
``1 / UNIT``, so the model doesn't depend on how the rows come in; what the driver gets are sums and counts.

Features are computed in the tasks, whatever the length: a text of more than ``BLOCK`` bytes is counted in blocks that begin before a blank (if one is near), so a
task's memory is bounded by blocks, not by texts.

Defined results: null, empty and blank texts have zero features and the score that follows; without labels of both kinds
every score is ``CUT``; repeated rows get equal scores; an id with both labels is learnt with both; labels other than 0
and 1 are ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from . import text as t
from .workers import ship

GROUP = 2048
LEAST = 64
UNIT = float(1 << 24)
BINS = 1024
FEW = 10_000  # scores that are looked at one by one
PAIRS = 8  # drawn for every document of the more frequent label
RIDGE = 1e-3
NEWTON_STEPS = 30
SEED = 17
CUT = 0.3
BLOCK = 1 << 20
NEAR = 4096
CLASSES = 8
FAR = 6.0  # standardised features end here

_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[:128] = 6
for _first, _last, _kind in ((65, 90, 0), (97, 122, 1), (48, 57, 2), (0, 32, 3), (10, 13, 4)):
    _CLASS[_first : _last + 1] = _kind
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5

PAIRED = CLASSES * CLASSES
#: Counts of a block: pairs of classes, bytes, words, bytes of words, words like the last, words like the last but one, lines.
N_COUNTS = PAIRED + 6
N_FEATURES = PAIRED + 6


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -FAR, FAR) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.raw(features) - self.threshold + np.log(CUT / (1 - CUT))
        # Exactly at the threshold, rounding must not fall below the cut.
        return np.where(self.raw(features) == self.threshold, CUT, 1 / (1 + np.exp(-np.clip(z, -60, 60))))


def cuts(data: np.ndarray, begin: int, end: int, block: int = BLOCK) -> list[int]:
    """Bounds of the blocks of a text: at most ``block`` bytes, before a blank if one is among the last ``NEAR``."""
    bounds = [begin]
    while end - bounds[-1] > block:
        at = bounds[-1] + block
        low = max(bounds[-1] + 1, at - NEAR)
        blanks = np.flatnonzero(~t.NOT_BLANK[data[low : at + 1]])
        bounds.append(low + int(blanks[-1]) if len(blanks) else at)
    return [*bounds, end]


def counts(blocks: pa.Array) -> np.ndarray:
    """``(blocks, N_COUNTS)`` of binary values."""
    data, offsets = t.flat(blocks)
    n = len(offsets) - 1
    out = np.zeros((n, N_COUNTS))
    if not len(data):
        return out
    kind = _CLASS[data].astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    inside = of[1:] == of[:-1]
    pair = (of[1:] * PAIRED + kind[:-1] * CLASSES + kind[1:])[inside]
    out[:, :PAIRED] = np.bincount(pair, minlength=n * PAIRED).reshape(n, PAIRED)
    found = t.words(blocks, t.NOT_BLANK)
    word_of = found.text_of
    out[:, PAIRED] = np.diff(offsets)
    out[:, PAIRED + 1] = np.diff(found.first)
    out[:, PAIRED + 2] = np.bincount(word_of, found.end - found.start, n)
    for back in (1, 2):
        if len(word_of) > back:
            same = (found.hash[back:] == found.hash[:-back]) & (word_of[back:] == word_of[:-back])
            out[:, PAIRED + 2 + back] = np.bincount(word_of[back:], same, n)
    out[:, PAIRED + 5] = np.bincount(of, data == 10, n)
    return out


def features(total: np.ndarray) -> np.ndarray:
    """``(texts, N_FEATURES)`` from the counts of whole texts."""
    size, words, letters, once, twice, lines = total[:, PAIRED:].T
    some = np.maximum(words, 1)
    return np.column_stack(
        [
            np.sqrt(total[:, :PAIRED] / np.maximum(size, 1)[:, None]),
            np.log1p(size), letters / some, once / some, twice / some,
            np.log1p(words / (lines + 1)), np.log1p(words) / np.maximum(np.log1p(size), 1),
        ]
    )


def text_features(column: pa.Array, block: int = BLOCK) -> np.ndarray:
    """Features of every text of a column, counted block by block."""
    data, offsets = t.flat(column)
    total, bounds, owner, held = np.zeros((len(column), N_COUNTS)), [], [], 0

    def flush() -> None:
        if bounds:
            raw = pa.py_buffer(data)
            slices = pa.Array.from_buffers(
                pa.large_binary(), len(bounds), [None, pa.py_buffer(np.array([b for b, _ in bounds] + [bounds[-1][1]])), raw]
            )
            np.add.at(total, owner, counts(slices))
            bounds.clear()
            owner.clear()

    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        edges = cuts(data, begin, end, block)
        for pair in zip(edges[:-1], edges[1:], strict=True):
            if held + pair[1] - pair[0] > block:
                flush()
                held = 0
            bounds.append(pair)
            owner.append(i)
            held += pair[1] - pair[0]
    flush()
    return features(total)


def standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -FAR, FAR)


def differences(z: np.ndarray, good: np.ndarray, pairs: int, seed: Sequence[int]) -> np.ndarray:
    """Feature differences of drawn pairs, preferred less other; none without both labels."""
    best, worst = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(best) or not len(worst):
        return np.zeros((0, z.shape[1]))
    draw = np.random.default_rng(seed)
    n = pairs * max(len(best), len(worst))
    # Every document of both labels takes part, the rarer ones more often.
    i = np.concatenate([draw.permutation(best) for _ in range(-(-n // len(best)))])[:n]
    j = np.concatenate([draw.permutation(worst) for _ in range(-(-n // len(worst)))])[:n]
    return z[i] - z[j]


def newton_sums(found: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairs, and the sums over them of the gradient and of the curvature of the loss."""
    p = 1 / (1 + np.exp(np.clip(found @ w, -60, 60)))  # probability of the wrong order
    return len(found), -(found.T @ p), (found.T * (p * (1 - p))) @ found


def newton(sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Weights of the least mean loss plus ridge; ``sums`` gives ``newton_sums`` of all pairs."""
    w = np.zeros(width)
    for _ in range(NEWTON_STEPS):
        n, gradient, curved = sums(w)
        step = np.linalg.solve(curved / n + RIDGE * np.eye(width), gradient / n + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spread_of(deviations: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.sqrt(deviations / n), 1e-3)


def train(x: np.ndarray, good: np.ndarray, share_of_bad: float, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """The model of one group of rows."""
    mean = x.mean(axis=0)
    spread = spread_of(((x - mean) ** 2).sum(axis=0), len(x))
    z = standardised(x, mean, spread)
    found = differences(z, good, pairs, (seed, 0))
    w = newton(lambda w: newton_sums(found, w), x.shape[1])
    # The labels' own shares, whatever the rows of either.
    weight = np.where(good == 1, (1 - share_of_bad) / (good == 1).sum(), share_of_bad / (good == 0).sum())
    return Model(mean, spread, w, quantile(z @ w, weight, share_of_bad))


def quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Middle between the values where the weights below reach ``share`` and the next larger one."""
    order = np.argsort(values, kind="stable")
    values, below = values[order], np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(below, share - 1e-9)), len(values) - 1)
    larger = values[values > values[at]]
    return float((values[at] + larger[0]) / 2) if len(larger) else float(values[at])


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in t.pieces(batches, "text"):
        x = text_features(piece.column("text"))
        bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
        lists = pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([piece.column("id"), lists], ["id", "features"])


def grouped(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``(group, rows ARRAY<STRUCT<label, own, features>>)`` of ``(id, label, features)``; ``own`` marks a row in one of its groups.

    A group is expected to have ``LEAST`` documents of the rarer label, so the chance of one without any is below 1e-27; of fewer
    than ``LEAST`` in all, every group has all.
    """
    n_groups = -(-max(sizes.values()) // GROUP)
    rarer = min(sizes, key=lambda label: (sizes[label], label))
    times = min(n_groups, -(-LEAST * n_groups // sizes[rarer]))
    copies = F.when(F.col("label") == rarer, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    group = F.pmod(F.pmod(F.xxhash64("id"), F.lit(n_groups)) + F.col("copy"), F.lit(n_groups))
    dealt = rows.withColumn("copy", F.explode(copies)).select(
        group.alias("group"), F.struct("label", (F.col("copy") == 0).alias("own"), "features").alias("row")
    )
    return dealt.groupBy("group").agg(F.collect_list("row").alias("rows"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(group, features, label, own)`` of every group, its rows in the same order however they came in."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(1).slice(i, 1).flatten()
            label = rows.field("label").to_numpy(zero_copy_only=False)
            own = rows.field("own").to_numpy(zero_copy_only=False)
            x = rows.field("features").flatten().to_numpy().reshape(len(label), N_FEATURES)
            order = np.lexsort((*x.T, own, label))
            yield batch.column(0)[i].as_py(), x[order], label[order], own[order]


def _summed(groups: DataFrame, part: Callable, width: int) -> np.ndarray:
    """Sums over all groups of the ``width`` numbers that ``part`` makes of ``(group, features, label, own)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.rint(part(*found) * UNIT))], ["place", "units"])

    units = F.sum(F.col("units").cast("decimal(28,0)"))
    out = np.zeros(width)
    for row in groups.mapInArrow(run, "place long, units double").groupBy("place").agg(units.alias("units")).collect():
        out[row["place"]] = float(row["units"]) / UNIT
    return out


def _newton_part(w: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Callable:
    def part(group, x, label, own):
        n, gradient, curved = newton_sums(differences(standardised(x, mean, spread), label, PAIRS, (SEED, group)), w)
        return np.concatenate([[n], gradient, curved.ravel()])

    return part


def _raw_scores(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, label, own in _groups(batches):
            raw = model.raw(x)
            yield pa.RecordBatch.from_arrays([pa.array(label[own]), pa.array(raw[own])], ["label", "raw"])

    return run


def quantile_of(scores: DataFrame, weights: dict[int, float], share: float) -> float:
    """``quantile`` of a table ``(label, raw)`` with a weight per label, narrowed down by counts: exact, nothing is gathered whole."""
    weighted = sum(F.count_if(F.col("label") == label) * F.lit(weight) for label, weight in weights.items())
    low, high, total = scores.agg(F.min("raw"), F.max("raw"), weighted).first()
    wanted, below = (share - 1e-9) * total, 0.0  # weight of the scores under ``low``
    while True:
        inside = scores.filter(F.col("raw").between(low, high))
        width = (high - low) / BINS
        if width == 0 or low + width == low or high - width == high or inside.count() <= FEW:
            break
        at = F.least(F.floor((F.col("raw") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(at.alias("bin")).agg(weighted.alias("w"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):
            if below + row["w"] >= wanted:
                break
            below += row["w"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high = row["low"], row["high"]
    for value, w in sorted(inside.groupBy("raw").agg(weighted.alias("w")).collect()):
        below += w
        if below >= wanted:
            break
    larger = scores.filter(F.col("raw") > value).agg(F.min("raw")).first()[0]
    return value if larger is None else (value + larger) / 2


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model | None:
    """From all labelled documents; None without both labels."""
    ship(documents.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.col(label_col).alias("given"))
    known = known.filter("given IN (0, 1) AND id IS NOT NULL").select("id", "label").distinct()
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    # Features meet the labels, so no text is shuffled.
    described = texts.mapInArrow(_featurer, f"id {texts.schema['id'].dataType.simpleString()}, features array<double>")
    rows = materialise(described.join(known, "id"), "quality-features")
    counted = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()}
    if len(counted) < 2:
        return None
    sizes, ids = ({label: r[name] for label, r in counted.items()} for name in ("n", "ids"))
    share_of_bad, n = ids[0] / (ids[0] + ids[1]), sizes[0] + sizes[1]
    groups = materialise(grouped(rows, sizes), "quality-groups")
    mean = _summed(groups, lambda group, x, label, own: x[own].sum(axis=0), N_FEATURES) / n
    spread = spread_of(_summed(groups, lambda group, x, label, own: ((x[own] - mean) ** 2).sum(axis=0), N_FEATURES), n)

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        found = _summed(groups, _newton_part(w, mean, spread), 1 + N_FEATURES + N_FEATURES**2)
        return found[0], found[1 : 1 + N_FEATURES], found[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)

    model = Model(mean, spread, newton(sums, N_FEATURES), 0.0)
    scores = materialise(groups.mapInArrow(_raw_scores(model), "label int, raw double"), "quality-scores")
    # The labels' own shares, whatever the rows of either.
    weights = {1: (1 - share_of_bad) / sizes[1], 0: share_of_bad / sizes[0]}
    return model._replace(threshold=quantile_of(scores, weights, share_of_bad))


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in t.pieces(batches, "text"):
            if model is None:
                scores = np.full(piece.num_rows, CUT)
            else:
                scores = model.scores(text_features(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(scores)], ["doc", "score"])

    return run


def quality(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, score)`` per document row; from ``CUT`` on a document ranks at or above the threshold."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc long, score double")
