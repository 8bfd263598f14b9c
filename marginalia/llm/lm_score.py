"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the ``SIDE`` words before and after it: their embeddings, one after the other,
go through a rectified layer and a softmax of two levels: over ``SETS`` of classes, then over the classes of one set, so
a word costs ``SETS + SET_SIZE`` outputs whatever the number of classes. A document's score is the sum of the conditional
log-probabilities of all its words.

Words. Counts of all words of all documents give the vocabulary. The ``INPUTS`` most frequent words have
embeddings of their own, the ``OUTPUTS`` most frequent ones outputs of their own. Up to ``KNOWN`` further words
are cut, in the order of their counts, into ``MIDDLE`` classes of about equal share; the tasks hold them. All others are in
``TAIL`` hashed classes. A word has the probability of its class times its share of the class's occurrences in
the corpus, so the probabilities of all words of the corpus add up to one. The counts of the words that the tasks
don't hold are joined in Spark, as whole billionths of logarithms, so that sums do not depend on order.

Training is data-parallel: in every round each task starts from the same parameters, takes
mini-batch steps over every ``ONE_IN``-th batch of consecutive words of all texts of its partition, and
gives its parameters, weighted with the number of places. The rounds take turns, so with as many rounds as ``ONE_IN`` every
word of the corpus is a target once. The parameters are averaged in grouped steps of at most ``FAN`` tasks each; what is gathered grows
with the corpus, what the driver gets is one set of parameters. Network and vocabulary have fixed sizes and
are broadcast.

Defined results: null, empty and wordless texts have 0 words and score 0, mean 0; words beyond a
text's ends are a mark of their own; repeated rows get equal scores; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from . import text as t
from .workers import ship

SIDE = 2
INPUTS = 4096
KNOWN = 65536
OUTPUTS = 112
MIDDLE = 128
TAIL = 16
DEPTH = 16
HIDDEN = 32
ROUNDS = 2
ONE_IN = 2
BATCH = 1024
ROWS = 32  # slots of a block of words of one set
RATE = 0.05
BLOCK = 4096  # parameters per averaged row
FAN = 64  # tasks that one step of the average adds up
AT_ONCE = 1024
COUNTS_HELD = 1 << 21
UNIT = 1e9  # logarithms of counts are summed in whole parts of this


class Vocabulary(NamedTuple):
    """Sorted hashes of the known words with their ranks; class and log-share in it by rank, 0 after the last."""

    hashes: np.ndarray
    ranks: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    class_counts: np.ndarray  # how often every output class occurs in the corpus

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Rank of every word, the number of known words for all others."""
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.ranks[at], len(self.hashes))

    def rest(self, rank: np.ndarray) -> np.ndarray:
        return rank == len(self.hashes)

    def inputs(self, h: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
        rank = self.rank(h) if rank is None else rank
        return np.where((rank < INPUTS) & ~self.rest(rank), rank, INPUTS + tail_class(h))

    def outputs(self, h: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Class of every word, and the log-probability of the word within it; for the rest, less the log of its count."""
        rank = self.rank(h) if rank is None else rank
        rest, tail = self.rest(rank), tail_class(h)
        within = np.where(rest, -np.log(np.maximum(self.class_counts[-TAIL:], 1))[tail], self.shares[rank])
        return np.where(rest, OUTPUTS + MIDDLE + tail, self.classes[rank]), within


EDGE = INPUTS + TAIL  # the mark beyond the ends of a text
N_INPUTS, N_CLASSES = INPUTS + TAIL + 1, OUTPUTS + MIDDLE + TAIL
STEPS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
SET_SIZE = 32
SETS = -(-N_CLASSES // SET_SIZE)  # classes in order, so the first sets hold the most frequent words
_SHAPES = [
    (N_INPUTS, DEPTH), (2 * SIDE * DEPTH, HIDDEN), (HIDDEN,),
    (HIDDEN, SETS), (SETS,), (SETS, HIDDEN, SET_SIZE), (SETS, SET_SIZE),
]
_SIZES = [int(np.prod(s)) for s in _SHAPES]
N_PARAMETERS = sum(_SIZES)


def tail_class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(60)).astype(np.int64)


def unpacked(parameters: np.ndarray) -> list[np.ndarray]:
    """Views of the flat parameters: embeddings, hidden weights and shifts, then weights and shifts of sets and of classes in them."""
    ends = np.cumsum(_SIZES)
    return [parameters[e - n : e].reshape(s) for e, n, s in zip(ends, _SIZES, _SHAPES, strict=True)]


def first_parameters(vocabulary: Vocabulary, seed: int = 5) -> np.ndarray:
    """Small random weights; the output shifts start at the classes' share of the corpus."""
    draw = np.random.default_rng(seed)
    flat = np.zeros(N_PARAMETERS, dtype=np.float32)
    embedding, hidden, _, of_sets, set_shift, of_classes, shift = unpacked(flat)
    embedding[:] = draw.normal(0, 0.3, embedding.shape)
    hidden[:] = draw.normal(0, 1 / np.sqrt(len(hidden)), hidden.shape)
    of_sets[:] = draw.normal(0, 0.05, of_sets.shape)
    of_classes[:] = draw.normal(0, 0.05, of_classes.shape)
    counts = np.full(SETS * SET_SIZE, 1e-9)
    counts[:N_CLASSES] = vocabulary.class_counts + 1.0
    counts = counts.reshape(SETS, SET_SIZE)
    set_shift[:] = np.log(counts.sum(axis=1) / counts.sum())
    shift[:] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return flat


def spaced(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of all texts with ``SIDE`` marks ``EDGE`` before and after each, and where every word is among them."""
    place = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(first) - 1), np.diff(first)) + 1)
    wide = np.full(len(ids) + SIDE * len(first), EDGE, dtype=np.uint16)
    wide[place] = ids
    return wide, place


def around(wide: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of ids that consecutive words look at, and the places in it of their neighbours, ``(n, 2 * SIDE)``."""
    low, high = place[0] - SIDE, place[-1] + SIDE + 1
    return wide[low:high], (place - low)[:, None] + STEPS


def _inputs(embedding: np.ndarray, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Embeddings of the neighbours of every word, side by side."""
    return embedding[ids][near].reshape(len(near), -1)


def _hidden(parts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    r = x @ parts[1]
    r += parts[2]
    return np.maximum(r, 0, out=r)


class Dealt(NamedTuple):
    """Words dealt to blocks of ``ROWS`` slots by the set of their class, so that each block needs one set's weights.

    The blocks of all sets are one batch of matrix products; slots left over in a set's last block count for nothing.
    """

    sets: np.ndarray  # set of every word
    members: np.ndarray  # class of every word within its set
    slots: np.ndarray  # slot of every word
    blocks: np.ndarray  # set of every block

    def put(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.blocks) * ROWS, r.shape[1]), dtype=np.float32)
        out[self.slots] = r
        return out.reshape(len(self.blocks), ROWS, -1)


def dealt(truth: np.ndarray) -> Dealt:
    sets = truth // SET_SIZE
    order = np.argsort(sets, kind="stable")
    counts = np.bincount(sets, minlength=SETS)
    blocks = -(-counts // ROWS)
    begin = ROWS * (np.cumsum(blocks) - blocks) - (np.cumsum(counts) - counts)
    slots = np.empty(len(truth), dtype=np.int64)
    slots[order] = begin[sets[order]] + np.arange(len(truth))
    return Dealt(sets, truth - sets * SET_SIZE, slots, np.repeat(np.arange(SETS), blocks))


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest logit of every row, exponentials of what is below it, and their sum."""
    top = z.max(axis=-1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    return top, z, z.sum(axis=-1, keepdims=True)


def class_log_probabilities(parts: list[np.ndarray], ids: np.ndarray, near: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Log-probability of the class ``truth`` of every word: of its set, and of the class in the set."""
    r, at, n = _hidden(parts, _inputs(parts[0], ids, near)), dealt(truth), len(truth)
    outer = r @ parts[3]
    outer += parts[4]
    inner = np.matmul(at.put(r), parts[5][at.blocks])
    inner += parts[6][at.blocks][:, None, :]
    inner = inner.reshape(-1, SET_SIZE)
    found = outer[np.arange(n), at.sets] + inner[at.slots, at.members]
    for z, rows in ((outer, slice(None)), (inner, at.slots)):
        top, _, total = _exponentials(z)
        found -= (top + np.log(total))[rows, 0]
    return found


def _update(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
    s += g * g
    p -= RATE * g / np.sqrt(s)


def _update_some(p: np.ndarray, s: np.ndarray, g: np.ndarray, rows: np.ndarray) -> None:
    """The same for some rows; the others have no gradient and keep their values."""
    squares = s[rows] + g * g
    s[rows] = squares
    p[rows] -= RATE * g / np.sqrt(squares)


def _step(parts: list[np.ndarray], squares: list[np.ndarray], ids: np.ndarray, near: np.ndarray, truth: np.ndarray) -> None:
    """One Adagrad step on a mini-batch of consecutive words, in place."""
    n, at = len(near), dealt(truth)
    x = _inputs(parts[0], ids, near)
    r = _hidden(parts, x)
    outer = r @ parts[3]
    outer += parts[4]
    _, _, total = _exponentials(outer)
    outer *= 1 / (n * total)
    outer[np.arange(n), at.sets] -= np.float32(1 / n)
    dealt_r, weights = at.put(r), parts[5][at.blocks]
    inner = np.matmul(dealt_r, weights)
    inner += parts[6][at.blocks][:, None, :]
    _, _, total = _exponentials(inner)
    share = np.zeros(len(at.blocks) * ROWS, dtype=np.float32)
    share[at.slots] = 1 / n
    inner *= share.reshape(-1, ROWS, 1) / total
    inner.reshape(-1, SET_SIZE)[at.slots, at.members] -= np.float32(1 / n)
    back = outer @ parts[3].T
    back += np.matmul(inner, weights.transpose(0, 2, 1)).reshape(-1, HIDDEN)[at.slots]
    back *= r > 0
    d_x = (back @ parts[1].T).reshape(n, 2 * SIDE, DEPTH)
    d_ids = np.zeros((len(ids), DEPTH), dtype=np.float32)
    # Consecutive words: at one offset no place occurs twice.
    for j in range(2 * SIDE):
        d_ids[near[:, j]] += d_x[:, j]
    by_id = np.argsort(ids, kind="stable")
    known = ids[by_id]
    start = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
    _update_some(parts[0], squares[0], np.add.reduceat(d_ids[by_id], start, axis=0), known[start])
    _update(parts[1], squares[1], x.T @ back)
    _update(parts[2], squares[2], back.sum(axis=0))
    _update(parts[3], squares[3], r.T @ outer)
    _update(parts[4], squares[4], outer.sum(axis=0))
    first = np.flatnonzero(np.append(True, at.blocks[1:] != at.blocks[:-1]))
    own = at.blocks[first]
    d_weights = np.matmul(dealt_r.transpose(0, 2, 1), inner)
    _update_some(parts[5], squares[5], np.add.reduceat(d_weights, first, axis=0), own)
    _update_some(parts[6], squares[6], np.add.reduceat(inner.sum(axis=1), first, axis=0), own)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)``: how often each word occurs, summed up in the task as far as memory allows."""

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        word, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(word)
        word, n = word[order], n[order]
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return word[start], np.add.reduceat(n, start)

    def batch(parts: list) -> pa.RecordBatch:
        word, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(t.signed(word)), pa.array(n)], ["word", "n"])

    parts, held = [], 0
    for piece in t.pieces(batches, "text"):
        word, n = np.unique(t.words(piece.column("text"), t.ALPHANUMERIC).hash, return_counts=True)
        parts.append((word, n))
        held += len(word)
        if held >= COUNTS_HELD:
            parts = [summed(parts)]
            held = len(parts[0][0])
            if held >= COUNTS_HELD // 2:
                yield batch(parts)
                parts, held = [], 0
    if held:
        yield batch(parts)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` for all words of all documents, written once."""
    counts = texts.mapInArrow(_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counts, "word-counts")


def vocabulary(texts: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """From the counts of all words of all documents."""
    counts = word_counts(texts) if counts is None else counts
    # The most frequent words without a sort: whole steps of the logarithm, as many as fit.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("types")).toArrow().sort_by([("step", "descending")])
    fits = np.cumsum(steps.column("types").to_numpy()) <= KNOWN
    least = min(INPUTS, KNOWN, sum(steps.column("types").to_pylist()))
    if steps.column("types").to_numpy()[fits].sum() >= least:
        lowest = int(steps.column("step").to_numpy()[fits][-1]) if fits.any() else 0
        top = counts.filter(step >= lowest).toArrow()
    else:
        top = counts.orderBy(F.desc("n"), "word").limit(least).toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    hashes, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(float)
    tail_of = F.pmod(F.shiftrightunsigned("word", 60), F.lit(TAIL)).cast("int").alias("tail")
    tails = counts.groupBy(tail_of).agg(F.sum("n").alias("n")).toArrow()
    tokens = np.zeros(TAIL)
    tokens[tails.column("tail").to_numpy()] = tails.column("n").to_numpy()
    np.subtract.at(tokens, tail_class(hashes), n)
    classes = np.arange(len(n) + 1)
    middle = n[OUTPUTS:]
    if len(middle):
        classes[OUTPUTS:-1] = OUTPUTS + ((np.cumsum(middle) - middle / 2) * (MIDDLE / middle.sum())).astype(np.int64)
    own = np.bincount(classes[:-1], n, OUTPUTS + MIDDLE)
    shares = np.append(np.log(n / own[classes[:-1]]), 0.0)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, classes, shares, np.concatenate([own, tokens]))


def _trainer(shared, turn: int, one_in: int) -> Callable:
    """``(task, block, n, values)``: the task's parameters times its number of places, cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        flat = start.copy()
        parts = unpacked(flat)
        squares = [np.full_like(p, 1e-5) for p in parts]
        n = 0
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            total = len(found.hash)
            rank = known.rank(found.hash)
            wide, place = spaced(known.inputs(found.hash, rank), found.first)
            truth, _ = known.outputs(found.hash, rank)
            begin = np.arange(turn % one_in * BATCH, total, one_in * BATCH)
            for i in np.random.default_rng(total + turn).permutation(begin):
                own = slice(i, min(i + BATCH, total))
                _step(parts, squares, *around(wide, place[own]), truth[own])
                n += own.stop - own.start
        if n:
            weighted = flat.astype(np.float64) * n
            blocks = [weighted[i : i + BLOCK].tolist() for i in range(0, N_PARAMETERS, BLOCK)]
            task = TaskContext.get().partitionId()
            columns = [[task] * len(blocks), list(range(len(blocks))), [n] * len(blocks), blocks]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["task", "block", "n", "values"]
            )

    return run


def _added(rows: pa.Table) -> pa.Table:
    """Sum of the at most ``FAN`` blocks of a group, in the order of tasks."""
    rows = rows.sort_by("task")
    values = rows.column("values").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
    return pa.table(
        {
            "task": pa.array([rows.column("task")[0].as_py() // FAN], pa.int64()),
            "block": pa.array([rows.column("block")[0].as_py()], pa.int32()),
            "n": pa.array([pc.sum(rows.column("n")).as_py()], pa.int64()),
            "values": t.list_array(values, np.array([0, len(values)]), pa.float64()),
        }
    )


def train(texts: DataFrame, known: Vocabulary, rounds: int = ROUNDS, one_in: int = ONE_IN) -> np.ndarray:
    """Parameters after ``rounds`` rounds over one of ``one_in`` batches of all texts each, in turn."""
    spark = texts.sparkSession
    kind = "task long, block int, n long, values array<double>"
    parameters = first_parameters(known)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((known, parameters))
        parts = texts.mapInArrow(_trainer(shared, turn, one_in), kind)
        # As many steps as the tasks need, so that no group holds more than FAN blocks.
        tasks = texts.rdd.getNumPartitions()
        while True:
            parts = parts.groupBy("block", F.floor(F.col("task") / FAN).alias("share")).applyInArrow(_added, kind)
            if tasks <= FAN:
                break
            tasks = -(-tasks // FAN)
        whole = parts.toArrow().sort_by("block")
        if whole.num_rows:
            values = np.concatenate([np.asarray(v) for v in whole.column("values").to_pylist()])
            parameters = (values / whole.column("n")[0].as_py()).astype(np.float32)
    return parameters


def _scorer(shared) -> Callable:
    """Scores without the counts of the words ``rest`` that the vocabulary doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        parts = unpacked(flat)
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            rank = known.rank(found.hash)
            wide, place = spaced(known.inputs(found.hash, rank), found.first)
            truth, within = known.outputs(found.hash, rank)
            each = np.empty(len(place))
            for i in range(0, len(place), AT_ONCE):
                own = slice(i, i + AT_ONCE)
                each[own] = class_log_probabilities(parts, *around(wide, place[own]), truth[own])
            total = np.concatenate([[0.0], np.cumsum(each + within)])
            n = np.diff(found.first)
            score = total[found.first[1:]] - total[found.first[:-1]]
            rest = known.rest(rank)
            bounds = np.concatenate([[0], np.cumsum(rest)])[found.first]
            rest = t.list_array(t.signed(found.hash[rest]), bounds, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), pa.array(n, pa.int64()), pa.array(score), rest],
                ["doc", "n_words", "log_likelihood", "rest"],
            )

    return run


def score(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, one_in: int = ONE_IN
) -> DataFrame:
    """``(doc, n_words, log_likelihood, mean_log_likelihood)`` per document row, in nats."""
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    counts = word_counts(texts.select("text"))
    known = vocabulary(texts.select("text"), counts)
    shared = spark.sparkContext.broadcast((known, train(texts.select("text"), known, rounds, one_in)))
    kind = "doc long, n_words long, log_likelihood double, rest array<long>"
    # The ids of the rows hold because the table is written.
    scored = texts.mapInArrow(_scorer(shared), kind).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "word-scores")
    units = F.round(F.log("n") * UNIT).cast("long").alias("units")
    words = scored.select("row", F.explode("rest").alias("word")).join(counts.select("word", units), "word")
    units = words.groupBy("row").agg(F.sum("units").alias("units"))
    total = F.col("log_likelihood") + F.coalesce(F.col("units") / UNIT, F.lit(0.0))
    scored = scored.drop("rest").join(units, "row", "left").withColumn("log_likelihood", total)
    mean = F.col("log_likelihood") / F.greatest("n_words", F.lit(1))
    return scored.select("doc", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))
