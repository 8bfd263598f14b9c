"""Scoring with a model that lives outside Spark (for example an ONNX session)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.labels import from_mask
from ..functions.numbers import reaches
from ..functions.text import EMPTY, NONE, skip_reason
from .triage import check_strict, require_columns

Predictor = Callable[[list[str]], np.ndarray]

#: Bytes of text that a model is given at once, besides one text that is longer.
PIECE_BYTES = 1 << 20


def onnx_loader(
    path: str, encode: Callable[[list[str]], dict[str, np.ndarray]]
) -> Callable[[], Predictor]:
    """A loader for an ONNX classifier whose first output is one logit per label.

    ``path`` must be readable on every executor; ``encode`` turns texts into model inputs.
    """

    def load() -> Predictor:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])

        def predict(texts: list[str]) -> np.ndarray:
            logits = session.run(None, encode(texts))[0]
            return 1.0 / (1.0 + np.exp(-logits))

        return predict

    return load


def score_external(
    df: DataFrame,
    load: Callable[[], Predictor],
    names: Sequence[str],
    text_col: str = "text",
    null_reason: str = EMPTY,
) -> DataFrame:
    """All columns plus ``skip_reason`` and ``probs``; a narrow transformation.

    ``load`` runs once per Python task and returns a function from texts to an array with one
    probability per text and model output; it gets about ``PIECE_BYTES`` of texts at a time, so that of a batch no copies
    are held as Python strings.  Rows are split by status before the Python stage, so
    skipped texts never reach it; outputs the model lacks are 0.0.
    """
    require_columns(df, [text_col])
    width = len(names)

    piece_bytes = PIECE_BYTES

    @F.arrow_udf("array<double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            out = np.zeros((len(texts), width))
            piece = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // piece_bytes
            bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high > low:
                    found = np.asarray(model(texts.slice(low, high - low).to_pylist()), dtype=float)
                    used = min(width, found.shape[1])
                    out[low:high, :used] = found[:, :used]
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    reason = skip_reason(F.col(text_col), null_reason, df.schema[text_col].dataType)
    triaged = df.withColumn("skip_reason", reason)
    text = F.col(text_col).cast("string")
    scored = triaged.filter(F.col("skip_reason") == NONE).withColumn("probs", predict(text))
    zeros = F.array(*[F.lit(0.0) for _ in names])
    skipped = triaged.filter(F.col("skip_reason") != NONE).withColumn("probs", zeros)
    return scored.unionByName(skipped)


def predict_external(
    df: DataFrame,
    load: Callable[[], Predictor],
    names: Sequence[str],
    text_col: str = "text",
    threshold: float = 0.5,
    strict: bool = False,
    max_length: int = 5000,
) -> DataFrame:
    """Predicted label lists; the strict input check runs first if asked for."""
    if strict:
        check_strict(df, text_col, max_length)
    scored = score_external(df, load, names, text_col)
    mask = F.transform("probs", lambda p: reaches(p, threshold))
    return scored.withColumn("predicted", from_mask(mask, names)).drop("probs", "skip_reason")
