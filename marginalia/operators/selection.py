"""Choosing the smoothing by validation score, stopping when it no longer improves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .metrics import candidate_scores, multilabel_metrics
from .model import MIN_DOCUMENTS, LabelModel, fit_alphas, pick_alpha, score_rows, with_predictions
from .triage import require_columns

# Candidate smoothing values, tried from the strongest to the weakest.
ALPHAS = (4.0, 2.0, 1.0, 0.5, 0.25)
PATIENCE = 2


@dataclass(frozen=True)
class Trial:
    step: int
    alpha: float
    micro_f1: float
    improved: bool


def evaluate(
    model: LabelModel,
    df: DataFrame,
    key: str,
    text_col: str = "text",
    labels_col: str = "labels",
    threshold: float = 0.5,
) -> DataFrame:
    """The metrics of ``model`` on a labelled table, as one row."""
    require_columns(df, [key])
    scored = score_rows(df.select(F.col(text_col).alias("_text"), F.col(labels_col).alias("_truth")), model, "_text")
    return multilabel_metrics(with_predictions(scored, model, threshold), model.labels, "_truth")


def validation_scores(
    candidates: LabelModel,
    validation: DataFrame,
    key: str,
    names: Sequence[str],
    text_col: str = "text",
    labels_col: str = "labels",
    threshold: float = 0.5,
) -> dict[int, float]:
    """Micro-F1 per candidate of a ``fit_alphas`` model, from one scoring pass."""
    require_columns(validation, [key])
    rows = validation.select(F.col(text_col).alias("_text"), F.col(labels_col).alias("_truth"))
    scored = score_rows(rows, candidates, "_text")
    found = candidate_scores(scored, len(candidates.labels) // len(names), names, threshold, "_truth")
    return {row["step"]: row["micro_f1"] for row in found.collect()}


def choose_alpha(
    counts: DataFrame,
    validation: DataFrame,
    key: str,
    names: Sequence[str],
    text_col: str = "text",
    labels_col: str = "labels",
    alphas: Sequence[float] = ALPHAS,
    patience: int = PATIENCE,
    min_documents: int = MIN_DOCUMENTS,
    threshold: float = 0.5,
) -> tuple[LabelModel, list[Trial]]:
    """Best model by validation micro-F1, and every trial up to the stop.

    The candidates share the counts, so all of them are scored in one pass over the validation
    rows; the rule (stop after ``patience`` trials without improvement) then reads the scores in
    order. The training texts are not read again. Without validation rows the first value is kept.
    """
    candidates = fit_alphas(counts, names, alphas, min_documents)
    found = validation_scores(
        candidates,
        validation,
        key,
        names,
        text_col,
        labels_col,
        threshold,
    )
    best, best_score, since, trials = 0, -1.0, 0, []
    for step, alpha in enumerate(alphas):
        if step not in found:
            break
        improved = found[step] > best_score
        trials.append(Trial(step, alpha, found[step], improved))
        if improved:
            best, best_score, since = step, found[step], 0
        else:
            since += 1
            if since >= patience:
                break
    return pick_alpha(candidates, names, best, alphas[best]), trials
