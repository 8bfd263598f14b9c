"""Language identification by a byte convolutional network.

A window of ``WINDOW`` bytes goes through a byte embedding, filters of several widths (rectified),
the maximum of every filter over the window, and a softmax over the languages. A document is cut
into consecutive windows over its whole text, its log-probabilities are the mean over them.

The network is small and trained in numpy on the driver from a bounded sample: the
``SAMPLE`` labelled rows with the smallest hash of id and text, and of every language the ``LEAST`` rows with the
smallest, so that rare languages are learnt too; up to ``SAMPLE_WINDOWS`` windows each, evenly
spread over the text. Everything else runs in the tasks, batch by batch of windows.

Defined results: null texts and texts without a letter are ``und`` with score 0; a short last window
is padded with zero bytes, which the embedding maps to zero; without labelled rows every document is
``und`` with score 0; repeated rows give equal results; the other columns are kept as they are under ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as t
from .workers import ship

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 3000
LEAST = 200
SAMPLE_WINDOWS = 3
EPOCHS = 6
BATCH = 64
RATE = 0.004
UNDETERMINED = "und"
WINDOWS_AT_ONCE = 64


class Network(NamedTuple):
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: tuple[np.ndarray, ...]  # per width (width * EMBEDDING, FILTERS)
    biases: tuple[np.ndarray, ...]
    output: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    shift: np.ndarray
    languages: tuple[str, ...]

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.output, self.shift]


def new_network(languages: tuple[str, ...], seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda *shape: draw.normal(0, 1, shape).astype(np.float32)
    embedding = normal(256, EMBEDDING) * 0.5
    embedding[0] = 0
    return Network(
        embedding,
        tuple(normal(w * EMBEDDING, FILTERS) / np.sqrt(w * EMBEDDING).astype(np.float32) for w in WIDTHS),
        tuple(np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS),
        normal(len(WIDTHS) * FILTERS, len(languages)) * 0.1,
        np.zeros(len(languages), dtype=np.float32),
        languages,
    )


def _spread(embedded: np.ndarray, width: int) -> np.ndarray:
    """``(windows, places, width * EMBEDDING)``: the embeddings under a filter at every place."""
    n, size, depth = embedded.shape
    shape, (a, b, c) = (n, size - width + 1, width * depth), embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, shape, (a, b, c))


def _pooled(net: Network, windows: np.ndarray, places: list | None = None) -> np.ndarray:
    """Largest rectified response of every filter; ``places`` collects where it was."""
    embedded = np.ascontiguousarray(net.embedding[windows])
    found = []
    for w, filters, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
        spread = _spread(embedded, w).reshape(-1, w * EMBEDDING)
        answer = (spread @ filters).reshape(len(windows), -1, FILTERS)
        if places is not None:
            places.append(answer.argmax(axis=1))
        found.append(np.maximum(answer.max(axis=1) + bias, 0))
    return np.concatenate(found, axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def window_scores(net: Network, windows: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for ``(n, WINDOW)`` bytes."""
    out = [
        _log_softmax(_pooled(net, windows[i : i + WINDOWS_AT_ONCE]) @ net.output + net.shift)
        for i in range(0, len(windows), WINDOWS_AT_ONCE)
    ]
    return np.concatenate(out) if out else np.empty((0, len(net.languages)), dtype=np.float32)


def _gradients(net: Network, windows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    places: list[np.ndarray] = []
    pooled = _pooled(net, windows, places)
    n = len(windows)
    error = np.exp(_log_softmax(pooled @ net.output + net.shift))
    error[np.arange(n), truth] -= 1
    error /= n
    back = (error @ net.output.T) * (pooled > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_biases = [], []
    rows = np.arange(n)[:, None]
    for j, (w, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = back[:, j * FILTERS : (j + 1) * FILTERS]
        under = windows[rows[:, :, None], places[j][:, :, None] + np.arange(w)]  # (n, FILTERS, w) bytes
        seen = net.embedding[under].reshape(n, FILTERS, w * EMBEDDING)
        d_filters.append(np.einsum("nf,nfk->kf", own, seen))
        d_biases.append(own.sum(axis=0))
        step = (own[:, :, None] * filters.T[None]).reshape(n, FILTERS, w, EMBEDDING)
        np.add.at(d_embedding, under.ravel(), step.reshape(-1, EMBEDDING))
    d_embedding[0] = 0
    return [d_embedding, *d_filters, *d_biases, pooled.T @ error, error.sum(axis=0)]


def train(windows: np.ndarray, truth: np.ndarray, languages: tuple[str, ...], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on mini-batches; classes weigh the same through sampling with equal shares."""
    net, draw = new_network(languages, seed), np.random.default_rng(seed)
    parts = net.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    by = [np.flatnonzero(truth == c) for c in range(len(languages))]
    steps = max(200, epochs * len(windows) // BATCH)
    for step in range(1, steps + 1):
        which = draw.integers(0, len(languages), BATCH)
        rows = np.array([by[c][draw.integers(len(by[c]))] for c in which])
        rate = RATE * (1 - step / (steps + 1))
        for p, g, m, v in zip(parts, _gradients(net, windows[rows], truth[rows]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, ``(n, WINDOW)``, and the text of each."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[text] + place * WINDOW
    room = offsets[text + 1] - begin
    padded = np.concatenate([data, np.zeros(WINDOW, dtype=np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    short = np.flatnonzero(room < WINDOW)
    windows[short] = np.where(np.arange(WINDOW) < room[short][:, None], windows[short], 0)
    return windows, text


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE
) -> Network | None:
    """A network for the non-null labels of ``labelled``, from ``sample`` of its rows and at most ``LEAST`` more a label."""
    text, n = F.col(text_col), F.length(text_col)
    # Evenly spread parts of a long text; WINDOW characters hold at least as many bytes.
    parts = [
        F.substring(text, (F.lit(i) * (n / SAMPLE_WINDOWS)).cast("int") + 1, F.lit(WINDOW)) if i else F.substring(text, 1, WINDOW)
        for i in range(SAMPLE_WINDOWS)
    ]
    rows = labelled.filter(F.col(label_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.col(label_col).cast("string").alias("label"), F.array(*parts).alias("parts"), F.xxhash64(id_col, text_col).alias("h")
    )
    hashes = rows.select("label", "h")
    last = hashes.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None
    # Each task passes on only its own LEAST smallest of a label.
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    own = hashes.withColumn("place", place).filter(F.col("place") <= LEAST).groupBy("label").agg(F.max("h").alias("own"))
    # Copies of a row have one hash and count once.
    chosen = (
        rows.join(F.broadcast(own), "label")
        .filter(F.col("h") <= F.greatest("own", F.lit(last)))
        .dropDuplicates(["label", "h"])
        .toArrow()
        .sort_by([("h", "ascending"), ("label", "ascending")])
    )
    labels = chosen.column("label").to_pylist()
    languages = tuple(sorted(set(labels)))
    rows, truth = [], []
    for label, own in zip(labels, chosen.column("parts").to_pylist(), strict=True):
        for i, part in enumerate(own):
            data = part.encode()[:WINDOW]
            if data and (i == 0 or len(data) == WINDOW):
                rows.append(np.frombuffer(data.ljust(WINDOW, b"\0"), dtype=np.uint8))
                truth.append(languages.index(label))
    return train(np.stack(rows), np.array(truth), languages)


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does a text have a letter? Texts without an ASCII letter are looked at by their characters."""
    n = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = n[offsets[1:]] > n[offsets[:-1]]
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
        found[d] = any(c.isalpha() for c in text)
    return found


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for piece in t.pieces(batches, "text"):
            data, offsets = t.flat(piece.column("text"))
            n = piece.num_rows
            languages, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
            if net is not None:
                windows, text = cut_windows(data, offsets)
                total = np.zeros((n, len(net.languages)))
                np.add.at(total, text, window_scores(net, windows))
                mean = total / np.maximum(np.bincount(text, minlength=n), 1)[:, None]
                share = np.exp(_log_softmax(mean))
                letters = _has_letter(data, offsets)
                best = share.argmax(axis=1)
                languages[letters] = np.array(net.languages, dtype=object)[best[letters]]
                score[letters] = share[np.arange(n), best][letters]
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), piece.column("text"), pa.array(languages, pa.string()), pa.array(score)],
                ["row", "text", "language", "score"],
            )

    return run


def identify(documents: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``(row, text, language, score)`` per document row; ``row`` is a struct of the other columns."""
    spark = documents.sparkSession
    ship(spark)
    others = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = documents.select(row.alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    run = _predictor(spark.sparkContext.broadcast(net))
    return rows.mapInArrow(run, f"row {kind}, text string, language string, score double")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by
