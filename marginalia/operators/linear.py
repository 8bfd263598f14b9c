"""Multi-label model as one regularised logistic regression per label, fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.text import EMPTY, NONE, skip_reason
from .model import document_tokens

FEATURES = 1 << 14


def _with_features(df: DataFrame, text_col: str, features: int) -> DataFrame:
    tokenised = df.withColumn("_tokens", document_tokens(F.col(text_col)))
    hashing = HashingTF(
        numFeatures=features, inputCol="_tokens", outputCol="_features", binary=True
    )
    return hashing.transform(tokenised).drop("_tokens")


def fit_linear(
    df: DataFrame,
    names: Sequence[str],
    text_col: str = "text",
    labels_col: str = "labels",
    features: int = FEATURES,
    iterations: int = 20,
    regularisation: float = 0.01,
    start: dict[str, LogisticRegressionModel] | None = None,
) -> dict[str, LogisticRegressionModel]:
    """One model per label; labels without both classes are left out.

    The hashed features are persisted once and shared by the fits.  ``start`` names models that
    keep their coefficients for labels absent from ``names``, so a refinement may cover a subset.
    """
    rows = _with_features(df, text_col, features).select(
        "_features", *[F.array_contains(labels_col, n).cast("double").alias(f"_y{i}")
                       for i, n in enumerate(names)]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        positives = rows.agg(
            F.count("*").alias("rows"),
            *[F.sum(f"_y{i}").alias(f"_y{i}") for i in range(len(names))],
        ).first()
        models = dict(start or {})
        for i, name in enumerate(names):
            if not 0 < (positives[f"_y{i}"] or 0) < positives["rows"]:
                continue
            trainer = LogisticRegression(
                featuresCol="_features",
                labelCol=f"_y{i}",
                maxIter=iterations,
                regParam=regularisation,
            )
            models[name] = trainer.fit(rows)
        return models
    finally:
        rows.unpersist()


def score_linear(
    df: DataFrame,
    models: dict[str, LogisticRegressionModel],
    key: str,
    names: Sequence[str],
    text_col: str = "text",
    null_reason: str = EMPTY,
    features: int = FEATURES,
) -> DataFrame:
    """``(key, skip_reason, probs)``: a narrow transformation, no shuffle.

    Skipped rows get 0.0 everywhere, as do labels without a model.
    """
    reason = skip_reason(F.col(text_col), null_reason, df.schema[text_col].dataType)
    rows = df.select(key, reason.alias("skip_reason"), F.col(text_col).alias("text"))
    valid = _with_features(
        rows.filter(F.col("skip_reason") == NONE), "text", features
    ).drop("text")
    for i, name in enumerate(names):
        if name in models:
            model = (
                models[name].copy()
                .setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}")
            )
            valid = model.transform(valid).drop(f"_r{i}", f"_c{i}")
    probs = [
        vector_to_array(F.col(f"_p{i}"))[1] if name in models else F.lit(0.0)
        for i, name in enumerate(names)
    ]
    scored = valid.select(key, "skip_reason", F.array(*probs).alias("probs"))
    zeros = F.array(*[F.lit(0.0) for _ in names]).alias("probs")
    skipped = rows.filter(F.col("skip_reason") != NONE).select(key, "skip_reason", zeros)
    return scored.unionByName(skipped)
