"""Multi-label model whose fit is a table of counts.

One independent Bernoulli model per label. The counts ``(token, label, n)`` hold everything the
fit needs: a null token counts documents, a null label counts all documents regardless of label.
Weights are integers in millionths, so sums do not depend on the order they are added in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import TrainingDataError
from ..functions.columns import all_named
from ..functions.labels import from_mask, multi_hot, name_array
from ..functions.numbers import reaches, sigmoid
from ..functions.text import EMPTY, NONE, skip_reason, tokens
from ..session import materialise
from .labels import vocabulary
from .skew import BROADCAST_BYTES, table_bytes
from .triage import require_columns

MICRO = 1_000_000
#: Documents that a token must occur in to get a weight; 1 keeps all tokens.
MIN_DOCUMENTS = 1
#: Labels that are counted side by side, one column each; more are counted as pairs.
FLAGGED = 32


@dataclass(frozen=True)
class LabelModel:
    """A fitted model: labels in output order, bias per label, token weights and the counts.

    ``weights`` is ``(token, df, w ARRAY<BIGINT>)`` with one entry of ``w`` per label.
    """

    labels: tuple[str, ...]
    bias: tuple[int, ...]
    weights: DataFrame
    counts: DataFrame
    alpha: float = 1.0
    min_documents: int = MIN_DOCUMENTS
    n_tokens: int | None = None
    token_bytes: int | None = None

    def size(self) -> int:
        """Bytes the weights take when held by a task; measured if it is not known yet."""
        fixed = row_bytes(len(self.labels))
        if self.n_tokens is None or self.token_bytes is None:
            return table_bytes(self.weights, fixed, "token")
        return self.n_tokens * fixed + self.token_bytes


def row_bytes(n_labels: int) -> int:
    """What a held token takes besides its text: an offset, and a number of four bytes per label."""
    return 4 + 4 * n_labels


def document_tokens(text: Column, max_length: int | None = None) -> Column:
    return F.array_distinct(tokens(text, max_length))


def token_counts(
    df: DataFrame,
    text_col: str = "text",
    labels_col: str = "labels",
    names: Sequence[str] | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """Sufficient statistics ``(token, label, n)`` of a labelled table.

    Each document contributes its distinct tokens and one null token. The grouping key is the
    token, pre-aggregated before the shuffle, so a token found in every document costs one row
    per task. Up to ``FLAGGED`` labels are summed side by side and only turned into rows afterwards; more are counted as
    pairs of a token and a label that occur together.
    """
    require_columns(df, [text_col, labels_col])
    if names is None:
        names = vocabulary(df, labels_col)
    if len(names) > FLAGGED:
        return _pair_counts(df, text_col, labels_col, names, max_length)
    hot = multi_hot(F.col(labels_col), names)
    found = F.coalesce(
        document_tokens(F.col(text_col), max_length), F.array().cast("array<string>")
    )
    no_token = F.array(F.lit(None).cast("string"))
    flags = [f"y{i}" for i in range(len(names))]
    # The array is written inside the explode: as a column of its own, the optimizer would infer a
    # filter on its size below the join and tokenise every text once more for it.
    pairs = df.select(
        F.explode(F.concat(no_token, found)).alias("token"),
        *[F.get(hot, F.lit(i)).alias(flag) for i, flag in enumerate(flags)],
    )
    per_token = pairs.groupBy("token").agg(
        F.count("*").alias("n"), *[F.sum(flag).alias(flag) for flag in flags]
    )
    entries = [F.struct(F.lit(None).cast("string").alias("label"), F.col("n").alias("n"))]
    entries += [
        F.struct(F.lit(name).alias("label"), F.col(flag).alias("n"))
        for name, flag in zip(names, flags)
    ]
    return per_token.select("token", F.inline(F.array(*entries))).filter(F.col("n") > 0)


def _pair_counts(
    df: DataFrame, text_col: str, labels_col: str, names: Sequence[str], max_length: int | None
) -> DataFrame:
    """The same counts from pairs: no column and no expression per label.

    A document's tokens are combined with its own labels and with no label. Pairs are summed before the shuffle, and
    their key is token and label, so neither a frequent token nor a frequent label is a hot key.
    """
    found = F.coalesce(document_tokens(F.col(text_col), max_length), F.array().cast("array<string>"))
    no_name = F.array(F.lit(None).cast("string"))
    known = F.array_intersect(F.coalesce(F.col(labels_col), F.array().cast("array<string>")), name_array(names))
    tokens_of = df.select(F.concat(no_name, known).alias("_labels"), F.explode(F.concat(no_name, found)).alias("token"))
    return tokens_of.select("token", F.explode("_labels").alias("label")).groupBy("token", "label").agg(F.count("*").alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of the union of the tables the parts were counted on."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("token", "label").agg(F.sum("n").alias("n"))


def _document_totals(counts: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and rows per label: as many values as there are labels."""
    totals = {r["label"]: r["n"] for r in counts.filter(F.col("token").isNull()).collect()}
    rows = totals.pop(None, 0)
    return rows, totals


def _prior(positives: int, rows: int, alpha: float) -> int:
    log_odds = math.log((positives + alpha) / (rows - positives + alpha))
    return math.floor(log_odds * MICRO + 0.5)


def _per_token(counts: DataFrame, names: Sequence[str], min_documents: int) -> DataFrame:
    """``(token, df, y)``: documents with the token, in all and per label.

    ``y`` has an entry per label, or, of more than ``FLAGGED`` labels, ``(label, n)`` for those the token occurs with.
    """
    if len(names) <= FLAGGED:
        own = [F.coalesce(F.sum(F.when(F.col("label") == name, F.col("n"))), F.lit(0)) for name in names]
        y = F.array(*own).cast("array<bigint>")
    else:
        y = F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))
    return (
        counts.filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.sum(F.when(F.col("label").isNull(), F.col("n"))).alias("df"), y.alias("y"))
        .filter(F.col("df") >= min_documents)
    )


def weight_table(
    per_token: DataFrame, names: Sequence[str], positives: Sequence[int], rows: int, alphas: Sequence[float]
) -> DataFrame:
    """``(token, df, w, absent)``: the log-odds a token adds when present, and its share of the
    bias, in millionths to the nearest whole. The arrays hold one entry per smoothing value and label, labels innermost.
    """
    if len(names) > FLAGGED:
        return _wide_weight_table(per_token, names, positives, rows, alphas)
    present, absent = [], []
    for alpha in alphas:
        for i, positive in enumerate(positives):
            # Odds with the smoothing totals cancelled: (with, without) inside and outside the label.
            inside = f"(y[{i}] + {float(alpha)!r}D)"
            inside_without = f"({positive + 2.0 * alpha!r}D - {inside})"
            outside = f"(df + {2.0 * alpha!r}D - {inside})"
            outside_without = f"({rows - positive + 2.0 * alpha!r}D - {outside})"
            share = (rows - positive + 2.0 * alpha) / (positive + 2.0 * alpha)
            present.append(f"{inside} * {outside_without} / ({inside_without} * {outside})")
            absent.append(f"{inside_without} / {outside_without} * {share!r}D")

    def logarithms(odds: list[str]) -> Column:
        """One SQL text is built much faster than columns."""
        return F.expr(f"array({', '.join(f'floor(ln({o}) * {MICRO} + 0.5D)' for o in odds)})")

    return per_token.select(
        "token", "df", logarithms(present).alias("w"), logarithms(absent).alias("absent")
    )


def _wide_weight_table(
    per_token: DataFrame, names: Sequence[str], positives: Sequence[int], rows: int, alphas: Sequence[float]
) -> DataFrame:
    """The same for many labels: a batch of tokens is one array over all labels, without an expression per label."""
    known = pa.array(list(names), pa.string())
    positive = np.array(positives, dtype=np.float64)

    def millionths(odds: np.ndarray) -> np.ndarray:
        return np.floor(np.log(odds) * MICRO + 0.5).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(known) * len(alphas)
        at_once = max(1, (1 << 20) // width)
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                flat = pc.list_flatten(part.column(2))
                token = np.repeat(np.arange(len(part)), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                label = pc.index_in(pc.struct_field(flat, 0), value_set=known)
                there = pc.is_valid(label).to_numpy(zero_copy_only=False)
                y = np.zeros((len(part), len(known)))
                y[token[there], label.drop_null().to_numpy()] = pc.struct_field(flat, 1).to_numpy(zero_copy_only=False)[there]
                df = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                present, absent = [], []
                for alpha in alphas:
                    inside = y + alpha
                    inside_without = (positive + 2.0 * alpha) - inside
                    outside = (df + 2.0 * alpha) - inside
                    outside_without = (rows - positive + 2.0 * alpha) - outside
                    share = (rows - positive + 2.0 * alpha) / (positive + 2.0 * alpha)
                    present.append(millionths(inside * outside_without / (inside_without * outside)))
                    absent.append(millionths(inside_without / outside_without * share))
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.hstack(x).ravel())) for x in (present, absent)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["token", "df", "w", "absent"])

    return per_token.mapInArrow(run, "token string, df long, w array<long>, absent array<long>")


def _column_sums(table: DataFrame, column: str) -> dict[int, int]:
    """Sums of the entries of an array column by place, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = pc.list_flatten(batch.column(0)).to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    sums = table.select(column).mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum("s").alias("s"))
    return {r["i"]: r["s"] for r in sums.collect()}


def fit_alphas(
    counts: DataFrame,
    names: Sequence[str],
    alphas: Sequence[float],
    min_documents: int = MIN_DOCUMENTS,
) -> LabelModel:
    """One model for all smoothing values at once.

    Its outputs are named ``<position of alpha>:<label>``, so one scoring pass gives the
    probabilities of every candidate.
    """
    if not names:
        raise TrainingDataError("no labels to fit")
    rows, per_label = _document_totals(counts)
    positives = [per_label.get(name, 0) for name in names]
    narrow = len(names) <= FLAGGED
    outputs = tuple(f"{step}:{name}" for step, _ in enumerate(alphas) for name in names)
    table = materialise(
        weight_table(_per_token(counts, names, min_documents), names, positives, rows, alphas), "weights"
    )
    sums = table.agg(
        F.count("*").alias("tokens"),
        F.coalesce(F.sum(F.octet_length("token").cast("bigint")), F.lit(0)).alias("bytes"),
        *([F.sum(F.get("absent", F.lit(i))).alias(f"b{i}") for i in range(len(outputs))] if narrow else []),
    ).first()
    shares = {i: sums[f"b{i}"] or 0 for i in range(len(outputs))} if narrow else _column_sums(table, "absent")
    priors = [_prior(positive, rows, alpha) for alpha in alphas for positive in positives]
    bias = tuple(shares.get(i, 0) + prior for i, prior in enumerate(priors))
    return LabelModel(
        outputs,
        bias,
        table.select("token", "df", "w"),
        counts,
        alphas[0],
        min_documents,
        sums["tokens"],
        sums["bytes"],
    )


def pick_alpha(
    candidates: LabelModel, names: Sequence[str], step: int, alpha: float
) -> LabelModel:
    """The model of one smoothing value out of a ``fit_alphas`` model, without fitting again."""
    k = len(names)
    return replace(
        candidates,
        labels=tuple(names),
        bias=candidates.bias[step * k : (step + 1) * k],
        weights=candidates.weights
        if len(candidates.labels) == k
        else candidates.weights.withColumn("w", F.slice("w", step * k + 1, k)),
        alpha=alpha,
    )


def fit_from_counts(
    counts: DataFrame,
    names: Sequence[str] | None = None,
    alpha: float = 1.0,
    min_documents: int = MIN_DOCUMENTS,
) -> LabelModel:
    """Weights and biases from a (written) table of counts."""
    if names is None:
        labels = counts.filter("token IS NULL AND label IS NOT NULL").select("label").collect()
        names = sorted(row["label"] for row in labels)
    return pick_alpha(fit_alphas(counts, names, [alpha], min_documents), names, 0, alpha)


def fit(
    df: DataFrame,
    text_col: str = "text",
    labels_col: str = "labels",
    alpha: float = 1.0,
    min_documents: int = MIN_DOCUMENTS,
    names: Sequence[str] | None = None,
    max_length: int | None = None,
) -> LabelModel:
    """Fit on a labelled table. The text is read once; everything later works on the counts."""
    if names is None:
        names = vocabulary(df, labels_col)
    counts = materialise(token_counts(df, text_col, labels_col, names, max_length), "counts")
    return fit_from_counts(counts, names, alpha, min_documents)


def refine(
    model: LabelModel,
    df: DataFrame,
    text_col: str = "text",
    labels_col: str = "labels",
    alpha: float | None = None,
    max_length: int | None = None,
) -> LabelModel:
    """Continue ``model`` with more labelled rows; the old texts are not read again.

    Equal to fitting once on old and new rows together; labels seen for the first time appear.
    """
    added = token_counts(df, text_col, labels_col, None, max_length)
    counts = materialise(merge_counts(model.counts, added), "counts")
    return fit_from_counts(
        counts, None, model.alpha if alpha is None else alpha, model.min_documents
    )


#: Tokens whose weights a task gathers at once.
AT_ONCE = 1 << 17
#: Held tokens that a batch is compared with at once; the lookup table of so many is all that comes on top of the held ones.
LOOKED_UP = 1 << 18
#: Frequencies below this one are told apart when the tokens to hold are chosen, larger ones by powers of two.
FINE = 4096


def _sizes_together(model: LabelModel) -> list[tuple[int, int, int]]:
    """``(frequency, tokens, bytes)`` from the most frequent tokens down, for tokens that share their rows of weights.

    A token's weights follow from its counts, so rare tokens have few different rows. Rows are told apart by a hash, which only
    measures; a few sums reach the driver.
    """
    level = F.when(F.col("df") < FINE, F.col("df")).otherwise(F.expr("shiftleft(1L, length(bin(df)) - 1)"))
    text = F.octet_length("token").cast("bigint")
    rows = model.weights.groupBy(level.alias("level"), F.xxhash64("w")).agg(F.count("*").alias("n"), F.sum(text).alias("b"))
    sizes = rows.groupBy("level").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("rows")).collect()
    each = row_bytes(len(model.labels))
    return sorted(((r["level"], r["n"], 4 * r["n"] + r["b"] + each * r["rows"]) for r in sizes), reverse=True)


def _frequency_to_hold(sizes: list[tuple[int, int, int]], most_bytes: int, most_tokens: int | None) -> int:
    """The least number of documents from which on tokens fit into ``most_bytes`` together."""
    bar, n, held = 1 << 62, 0, 0
    for level, more, size in sizes:
        n, held = n + more, held + size
        if held > most_bytes or (most_tokens is not None and n > most_tokens):
            break
        bar = level
    return bar


def _held(weights: DataFrame, width: int, together: bool) -> tuple[pa.Array, np.ndarray | None, np.ndarray]:
    """``(names, starts, matrix)``: tokens and their rows of weights; logarithms of doubles in millionths fit four bytes.

    ``together`` holds equal rows once: the tokens stand in the order of their rows, those of row i from ``starts[i]`` on.
    """
    def matrix_of(table: pa.Table) -> np.ndarray:
        return pc.list_flatten(table.column("w")).to_numpy().astype(np.int32).reshape(-1, width)

    if not together:
        table = weights.select("token", F.col("w").cast("array<int>").alias("w")).toArrow()
        return table.column("token").combine_chunks(), None, matrix_of(table)
    rows = weights.select("w").distinct().toArrow()
    numbered = rows.append_column("kind", pa.array(np.arange(rows.num_rows, dtype=np.int32)))
    kinds = F.broadcast(weights.sparkSession.createDataFrame(numbered))
    table = weights.join(kinds, "w").select("token", "kind").toArrow()
    kind = table.column("kind").to_numpy()
    order = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[order], np.arange(rows.num_rows, dtype=np.int32))
    return table.column("token").combine_chunks().take(pa.array(order)), starts, matrix_of(rows)


def _gather(model: LabelModel, weights: DataFrame, together: bool = False, with_rest: bool = False):
    """Function from arrays of distinct tokens to logits, over weights held by every task.

    Called with weights of a checked size only. The function travels to the Python workers by
    value; a batch of rows is one lookup of its different tokens, one gather and one sum over the weight matrix, all on Arrow's own arrays.
    ``with_rest`` gives ``(z, rest)``, ``rest`` being the tokens that are not held.
    """
    width = len(model.labels)
    shared = weights.sparkSession.sparkContext.broadcast(_held(weights, width, together))
    bias = np.array(model.bias, dtype=np.int64)

    def places(tokens_of: pa.Array, names: pa.Array) -> np.ndarray:
        """Where each token stands among ``names``, -1 if nowhere."""
        place = np.full(len(tokens_of), -1, dtype=np.int32)
        for low in range(0, len(names), LOOKED_UP):
            at = pc.index_in(tokens_of, value_set=names.slice(low, LOOKED_UP))
            place[pc.is_valid(at).to_numpy(zero_copy_only=False)] = at.drop_null().to_numpy() + low
        return place

    @F.arrow_udf("struct<z: array<bigint>, rest: array<string>>" if with_rest else "array<bigint>")
    def gather(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, starts, matrix = shared.value
        for found in batches:
            sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            coded = pc.list_flatten(found).dictionary_encode()
            place = places(coded.dictionary, names)
            if starts is not None:
                place[place >= 0] = np.searchsorted(starts, place[place >= 0], side="right") - 1
            place = place[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
            rest = None
            if with_rest:
                missing = place < 0
                counts = np.bincount(row[missing], minlength=len(found))
                bounds = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                rest = pa.ListArray.from_arrays(bounds, coded.dictionary.take(coded.indices.filter(pa.array(missing))))
            there = place >= 0
            row, place = row[there], place[there]
            out = np.zeros((len(found), width), dtype=np.int64)
            for low in range(0, len(row), AT_ONCE):  # a row over two slices is summed in both
                own = row[low : low + AT_ONCE]
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[start]] += np.add.reduceat(matrix[place[low : low + AT_ONCE]], start, axis=0, dtype=np.int64)
            out += bias
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * width)
            z = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
            yield z if rest is None else pa.StructArray.from_arrays([z, rest], ["z", "rest"])

    return gather


def _triaged(df: DataFrame, text_col: str, null_reason: str) -> DataFrame:
    reason = skip_reason(F.col(text_col), null_reason, df.schema[text_col].dataType)
    return df.withColumn("skip_reason", reason)


def score(
    df: DataFrame,
    model: LabelModel,
    key: str,
    text_col: str = "text",
    null_reason: str = EMPTY,
    max_length: int | None = None,
    heavy_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, skip_reason, z, probs)`` for every row; skipped rows get 0.0 everywhere.

    One row comes out per row of ``df``, also for null and repeated keys; see ``score_rows``.
    """
    require_columns(df, [key, text_col])
    rows = df.select(key, F.col(text_col).alias("_text"))
    return _scored(rows, [key], model, "_text", null_reason, max_length, heavy_rows, broadcast_bytes)


def _probabilities(logits: Column, valid: Column, model: LabelModel) -> Column:
    found = F.transform(logits, lambda z: F.when(valid, sigmoid(z / F.lit(float(MICRO)))).otherwise(F.lit(0.0)))
    return found.alias("probs")


def score_rows(
    df: DataFrame,
    model: LabelModel,
    text_col: str = "text",
    null_reason: str = EMPTY,
    max_length: int | None = None,
    heavy_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All columns of ``df`` plus ``skip_reason`` and ``probs``.

    Weights that measure at most ``broadcast_bytes`` are held by every task, and scoring is a narrow
    step: no shuffle and no join. Weights that are larger with a row per token are held with each different row once, if that fits.
    Beyond that, the tokens of the most training documents are held, as many as fit (at most ``heavy_rows``
    if given), and the narrow step is written with the tokens it did not find. Only those, the rare ones, meet the other weights in a shuffle
    join, as pairs with the number of their row; the sums are added to the written rows. Rows are told apart by number, so copies of a text need no care.
    """
    require_columns(df, [text_col])
    scored = _scored(df, df.columns, model, text_col, null_reason, max_length, heavy_rows, broadcast_bytes)
    return scored.select(*all_named(df.columns), "skip_reason", "probs")


def _scored(
    df: DataFrame,
    keep: Sequence[str],
    model: LabelModel,
    text_col: str,
    null_reason: str,
    max_length: int | None,
    heavy_rows: int | None,
    broadcast_bytes: int,
) -> DataFrame:
    """Columns ``keep`` of ``df`` with ``skip_reason``, ``z`` and ``probs``."""
    kept = [*all_named(keep), F.col("skip_reason")]
    triaged = _triaged(df, text_col, null_reason)
    valid = F.col("skip_reason") == NONE
    found = F.when(valid, document_tokens(F.col(text_col).cast("string"), max_length))
    apart = bool(model.labels) and model.size() <= broadcast_bytes
    sizes = [] if apart else _sizes_together(model)
    if apart or (model.labels and sum(size for *_, size in sizes) <= broadcast_bytes):
        scored = triaged.select(*kept, _gather(model, model.weights, together=not apart)(found).alias("z"))
        return scored.withColumn("probs", _probabilities(F.col("z"), valid, model))
    bar = _frequency_to_hold(sizes, max(broadcast_bytes, BROADCAST_BYTES), heavy_rows)
    held, rare = model.weights.filter(F.col("df") >= bar), model.weights.filter(F.col("df") < bar)
    numbered = triaged.select(*kept, F.monotonically_increasing_id().alias("_row"), _gather(model, held, together=True, with_rest=True)(found).alias("_found"))
    written = materialise(numbered, "held-scores")
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(len(model.labels))]
    added = written.select("_row", F.explode("_found.rest").alias("token")).join(rare, "token").groupBy("_row").agg(*sums)
    z = [F.get("_found.z", F.lit(i)) + F.coalesce(f"z{i}", F.lit(0)) for i in range(len(model.labels))]
    # The sums come dealt by row; the rows meet them there.
    joined = written.join(added.withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left")
    scored = joined.select(*kept, F.array(*z).cast("array<bigint>").alias("z"))
    return scored.withColumn("probs", _probabilities(F.col("z"), valid, model))


def with_predictions(scored: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Add ``predicted``: labels whose probability reaches the threshold, in label order."""
    mask = F.transform("probs", lambda p: reaches(p, threshold))
    return scored.withColumn("predicted", from_mask(mask, model.labels))


def with_category_columns(
    scored: DataFrame, model: LabelModel, categories: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """One ``DOUBLE`` column per category; categories the model does not know are 0.0."""
    wanted = list(model.labels if categories is None else categories)
    columns = []
    for name in wanted:
        if name in model.labels:
            value = F.get("probs", F.lit(model.labels.index(name)))
        else:
            value = F.lit(0.0)
        columns.append((F.round(value, digits) if digits is not None else value).alias(name))
    kept = [c for c in scored.columns if c not in ("probs", "z", "skip_reason")]
    return scored.select(*all_named(kept), *columns, "skip_reason")
