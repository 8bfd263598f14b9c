"""Multi-label metrics from truth and prediction vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import multi_hot, name_array
from ..functions.numbers import ratio, reaches


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def known_labels(labels: Column, names: Sequence[str]) -> Column:
    """The distinct labels of a row that the vocabulary has; none for a null list."""
    return F.array_intersect(F.coalesce(labels, F.array().cast("array<string>")), name_array(names))


def confusion(
    df: DataFrame, names: Sequence[str], truth_col: str = "labels", predicted_col: str = "predicted"
) -> DataFrame:
    """``(label, tp, fp, fn)`` for every label of the vocabulary."""
    return cells(df, names, truth_col, predicted_col).filter("label IS NOT NULL").select("label", "tp", "fp", "fn")


def cells(
    df: DataFrame, names: Sequence[str], truth_col: str = "labels", predicted_col: str = "predicted"
) -> DataFrame:
    """Per label ``tp, fp, fn``; a row without label has the table's ``rows`` and ``exact`` matches.

    A row of ``df`` gives one cell for every label that is true or predicted in it, and one for the totals, whatever
    the size of the vocabulary: what is neither, is counted by its absence. Cells are summed before the shuffle, so
    a label found in every row costs one row per task. Labels that are never true nor predicted are added with zeros.
    """
    none = F.lit(None).cast("string")
    y, g = F.col("y"), F.col("g")
    both = df.select(known_labels(F.col(truth_col), names).alias("y"), known_labels(F.col(predicted_col), names).alias("g"))
    same = (F.size(y) == F.size(g)) & (F.size(F.array_except(y, g)) == 0)
    total = F.struct(none.alias("label"), F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("r"), same.cast("int").alias("e"))

    def cell(label: Column, t: int, p: int) -> Column:
        return F.struct(label.alias("label"), F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(0).alias("r"), F.lit(0).alias("e"))

    parts = [
        F.array(total),
        F.transform(F.array_intersect(y, g), lambda x: cell(x, 1, 1)),
        F.transform(F.array_except(y, g), lambda x: cell(x, 1, 0)),
        F.transform(F.array_except(g, y), lambda x: cell(x, 0, 1)),
    ]
    spark = df.sparkSession
    unseen = spark.createDataFrame([(name,) for name in names], "label STRING").select(
        "label", *[F.lit(0).alias(c) for c in "tpre"]
    )
    found = both.select(F.inline(F.concat(*parts))).unionByName(unseen)
    t, p = F.col("t"), F.col("p")
    return found.groupBy("label").agg(
        F.sum(t * p).alias("tp"),
        F.sum((1 - t) * p).alias("fp"),
        F.sum(t * (1 - p)).alias("fn"),
        F.sum("r").alias("rows"),
        F.sum("e").alias("exact"),
    )


def candidate_scores(df: DataFrame, steps: int, names: Sequence[str], threshold: float, truth_col: str = "labels") -> DataFrame:
    """``(step, micro_f1)`` of several models at once, from ``probs`` with one run of ``names`` per step.

    The score needs no counts per label: true and predicted labels of a row and those that are both, summed per
    step. So every row gives numbers of its own, nothing is exploded, and all steps are one aggregate.
    """
    k = len(names)
    truth = multi_hot(F.col(truth_col), names)
    sums = [F.sum(F.aggregate("y", F.lit(0), lambda n, v: n + v)).alias("true")]
    for step in range(steps):
        own = F.transform(F.slice("probs", step * k + 1, k), lambda p: reaches(p, threshold).cast("int"))
        sums.append(F.sum(F.aggregate(own, F.lit(0), lambda n, v: n + v)).alias(f"p{step}"))
        hits = F.zip_with(own, F.col("y"), lambda p, v: p * v)
        sums.append(F.sum(F.aggregate(hits, F.lit(0), lambda n, v: n + v)).alias(f"tp{step}"))
    totals = df.select(truth.alias("y"), "probs").agg(F.count("*").alias("rows"), *sums).filter("rows > 0")
    each = [
        F.struct(
            F.lit(step).alias("step"), ratio(2 * F.col(f"tp{step}"), F.col("true") + F.col(f"p{step}")).alias("micro_f1")
        )
        for step in range(steps)
    ]
    return totals.select(F.inline(F.array(*each)))


def label_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label",
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def micro_f1() -> Column:
    """Aggregate over ``cells`` or ``confusion`` rows."""
    return _f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))


def overall_metrics(counts: DataFrame) -> DataFrame:
    """One row from ``cells``: micro and macro scores and the share of rows predicted exactly."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    macro = F.avg(F.when(F.col("label").isNotNull(), _f1(F.col("tp"), F.col("fp"), F.col("fn"))))
    return counts.agg(
        micro_f1().alias("micro_f1"),
        F.coalesce(macro, F.lit(0.0)).alias("macro_f1"),
        ratio(tp, tp + fp).alias("micro_precision"),
        ratio(tp, tp + fn).alias("micro_recall"),
        ratio(F.max("exact"), F.max("rows")).alias("exact_match"),
    )


def multilabel_metrics(
    df: DataFrame, names: Sequence[str], truth_col: str = "labels", predicted_col: str = "predicted"
) -> DataFrame:
    return overall_metrics(cells(df, names, truth_col, predicted_col))
