"""End-to-end jobs: many files, one table, training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import all_named
from ..functions.text import NAN
from ..operators.labels import label_counts, labelled_table
from ..operators.model import (
    MIN_DOCUMENTS,
    LabelModel,
    score_rows,
    token_counts,
    with_category_columns,
    with_predictions,
)
from ..operators.profile import profile_rows
from ..operators.quality import enforce, light_gate, recommendations, text_facts, training_gate
from ..operators.selection import ALPHAS, PATIENCE, Trial, choose_alpha, evaluate
from ..operators.split import TEST, TRAIN, VALIDATION, split_sizes, with_split
from ..operators.summary import batch_summary, category_summary, run_summary
from ..operators.triage import check_strict, per_file_skips, require_columns, skip_totals, with_skip_reason
from ..session import materialise
from ..sinks.models import save_model
from ..sinks.tables import combined_path, save, save_per_file, save_predictions
from ..sources.files import LATIN1, ValidatedFiles, bare_path, validate_files


@dataclass(frozen=True)
class BatchRun:
    """Tables a batch run leaves behind."""

    rows: DataFrame
    files: DataFrame
    summary: DataFrame
    skips: DataFrame
    seconds: float
    combined_to: str | None


def process_files(
    spark: SparkSession,
    paths: Sequence[str],
    model: LabelModel,
    output_dir: str | None = None,
    prefix: str = "classified_",
    text_col: str = "text",
    categories: Sequence[str] | None = None,
    combine: bool = False,
    kind: str = "parquet",
    validated: ValidatedFiles | None = None,
) -> BatchRun:
    """Score all files in one job; bad files are reported and do not stop the good ones.

    ``validated`` takes the result of an earlier ``validate_files``.
    """
    started = datetime.now(timezone.utc)
    validated = validate_files(spark, paths, text_col) if validated is None else validated
    scored = score_rows(validated.rows, model, text_col, null_reason=NAN)
    wide = with_category_columns(scored, model, categories)
    combined_to = None
    if output_dir is not None and kind == "parquet":
        # The per-file output is the scored table; it is read back instead of written twice.
        written = save_per_file(wide, output_dir, started, prefix)
        result = spark.read.schema(wide.schema).parquet(written).select(*all_named(wide.columns))
    else:
        result = materialise(wide, "batch")
        if output_dir is not None:
            save_per_file(result, output_dir, started, prefix, kind=kind)
    if output_dir is not None and combine:
        combined_to = combined_path(output_dir, started, prefix)
        save(result.drop("file_path"), combined_to, kind)
    keyed = result.withColumn("file_key", bare_path(F.col("file_path")))
    # Counted by file, then rolled up to the paths that were handed in.
    requests = validated.files.select("requested", F.col("bare").alias("file_key"))
    per_file = skip_totals(keyed, ["file_key"]).join(requests, "file_key").groupBy("requested")
    per_path = per_file.agg(F.sum("total_rows").alias("total_rows"), F.sum("skipped").alias("skipped"))
    rows, skipped = F.coalesce("total_rows", F.lit(0)), F.coalesce("skipped", F.lit(0))
    files = validated.report.join(per_path, F.col("file_path") == F.col("requested"), "left").select(
        "source_file",
        bare_path(F.col("file_path")).alias("file_key"),
        F.when(rows > 0, "ok").otherwise("failed").alias("status"),
        F.col("status").alias("check"),
        rows.alias("total_rows"),
        (rows - skipped).alias("processed"),
        skipped.alias("skipped"),
    )
    return BatchRun(
        result,
        files,
        batch_summary(files),
        per_file_skips(keyed, "file_key"),
        (datetime.now(timezone.utc) - started).total_seconds(),
        combined_to,
    )


def dry_run(spark: SparkSession, paths: Sequence[str], text_col: str = "text") -> DataFrame:
    """File profiles without scoring: rows, rates, lengths, encoding, size, issues, error.

    Profiles come from the scan; nothing of the size of the data is written. A file that is not
    UTF-8 has the issue ``encoding``, one with records that do not fit its header ``misfits``.
    """
    validated = validate_files(spark, paths, text_col)
    names = validated.files.select("requested", F.col("bare").alias("file_key"))
    triaged = with_skip_reason(validated.rows, text_col, null_reason=NAN).withColumn(
        "file_key", bare_path(F.col("file_path"))
    )
    # The table of names is a written one: Spark knows its size and broadcasts it if it is small.
    profiles = profile_rows(triaged.join(names, "file_key"), "requested", text_col)
    facts = validated.files.groupBy("requested").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("n_misfits").alias("misfits"),
        F.max("n_rows").alias("most_rows"),
        F.when(F.bool_or(F.col("encoding") == LATIN1), LATIN1).otherwise(F.min("encoding")).alias("encoding"),
    )
    good = F.col("check") == "ok"
    error = F.when(~good, F.col("check"))
    profiled = F.col("total_rows").isNotNull()
    issue = lambda code, n: F.struct(
        F.lit(code).alias("code"), n.cast("bigint").alias("n"), F.lit(0.0).alias("pct")
    )
    more = F.array_compact(
        F.array(
            F.when(F.col("encoding") == LATIN1, issue("encoding", F.lit(1))),
            F.when(F.col("misfits") > 0, issue("misfits", F.col("misfits"))),
        )
    )
    return (
        validated.report.select("file_path", F.col("source_file").alias("file"), F.col("status").alias("check"))
        .join(profiles.withColumnRenamed("requested", "file_path"), "file_path", "left")
        .join(facts.withColumnRenamed("requested", "file_path"), "file_path", "left")
        .select(
            "file",
            F.when(~good, "error").otherwise(F.col("status")).alias("status"),
            F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
            F.coalesce("empty_rate", F.lit(0.0)).alias("empty_rate"),
            F.coalesce("avg_text_length", F.lit(0)).alias("avg_text_length"),
            F.coalesce("max_text_length", F.lit(0)).alias("max_text_length"),
            F.coalesce("encoding", F.lit("unknown")).alias("encoding"),
            "size_bytes",
            F.when(profiled, F.concat("issues", more)).alias("issues"),
            error.alias("error"),
        )
    )


@dataclass(frozen=True)
class InferenceRun:
    rows: DataFrame
    summary: DataFrame
    categories: DataFrame


def run_inference(
    df: DataFrame,
    model: LabelModel,
    key: str,
    text_col: str = "text",
    categories: Sequence[str] | None = None,
    output: str | None = None,
    strict: bool = False,
    max_length: int = 5000,
    threshold: float = 0.5,
) -> InferenceRun:
    """One table: predictions, summary, optional wide output; the strict check runs if asked for.

    Every row of ``df`` comes out, also one without ``key``: rows are scored by their texts.
    """
    require_columns(df, [key, text_col])
    if strict:
        check_strict(df, text_col, max_length)
    wanted = list(model.labels if categories is None else categories)
    predicted = with_predictions(score_rows(df, model, text_col), model, threshold)
    kept = F.filter("predicted", lambda name: name.isin(wanted)) if categories else F.col("predicted")
    rows = materialise(
        predicted.withColumn("predicted", kept).drop("probs", "skip_reason"), "predictions"
    )
    if output is not None:
        save_predictions(rows, output)
    return InferenceRun(rows, run_summary(rows, "predicted"), category_summary(rows, wanted, "predicted"))


@dataclass(frozen=True)
class TrainingRun:
    model: LabelModel
    version: int | None
    metrics: dict[str, float]
    sizes: dict[str, int]
    trials: list[Trial]
    warnings: list[str]
    advice: list[str]


def train(
    df: DataFrame,
    key: str,
    model_root: str | None = None,
    text_col: str = "text",
    labels_col: str = "labels",
    test_size: float = 0.1,
    valid_size: float = 0.1,
    seed: int = 42,
    alphas: Sequence[float] = ALPHAS,
    patience: int = PATIENCE,
    min_documents: int = MIN_DOCUMENTS,
    threshold: float = 0.5,
    gate: bool = True,
    base: LabelModel | None = None,
) -> TrainingRun:
    """Labelled table to a versioned model: layout, gates, split, fit, selection, evaluation.

    With ``base`` the counts of that model are added to the new training counts (refinement).
    """
    table = materialise(labelled_table(df, text_col, labels_col, [key]), "labelled")
    warnings: list[str] = []
    if gate:
        enforce(light_gate(table))
    # The texts are looked at once for the gate and the advice, the labels once for the gate and the vocabulary.
    facts, counted = materialise(text_facts(table), "facts"), materialise(label_counts(table), "label-counts")
    if gate:
        warnings = enforce(training_gate(table, facts=facts, counts=counted))
    advice = [row["advice"] for row in recommendations(table, facts=facts).collect()]
    names = sorted(row["label"] for row in counted.filter("label IS NOT NULL").select("label").collect())
    parts = with_split(table, key, test_size, valid_size, seed)
    sizes = {row["split"]: row["n"] for row in split_sizes(parts).collect()}
    training = parts.filter(F.col("split") == TRAIN)
    counts = token_counts(training, names=names)
    if base is not None:
        counts = base.counts.unionByName(counts).groupBy("token", "label").agg(F.sum("n").alias("n"))
        names = sorted({*names, *base.labels})
    counts = materialise(counts, "counts")
    model, trials = choose_alpha(
        counts,
        parts.filter(F.col("split") == VALIDATION),
        key,
        names,
        alphas=alphas,
        patience=patience,
        min_documents=min_documents,
        threshold=threshold,
    )
    metrics = evaluate(
        model, parts.filter(F.col("split") == TEST), key, threshold=threshold
    ).first().asDict()
    version = None
    if model_root is not None:
        version = save_model(
            model,
            model_root,
            {
                "labels": names,
                "num_labels": len(names),
                "num_samples": sum(sizes.values()),
                "sizes": sizes,
                "threshold": threshold,
                "alpha": model.alpha,
                "trials": [t.__dict__ for t in trials],
                "test_metrics": metrics,
            },
        )
    return TrainingRun(model, version, metrics, sizes, trials, warnings, advice)
