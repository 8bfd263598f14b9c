"""Run, category and batch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..categories import DEFAULT_CATEGORIES
from ..functions.numbers import percent, ratio
from .triage import skip_totals


def category_table(
    spark: SparkSession, categories: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """The ordered category list: ``(idx, category)``."""
    return spark.createDataFrame(list(enumerate(categories)), "idx INT, category STRING")


def run_summary(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """One row: rows, assigned labels, rows without a label, labels per classified row."""
    size = F.greatest(F.coalesce(F.size(labels_col), F.lit(0)), F.lit(0))
    totals = df.agg(
        F.count("*").alias("total_comments"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_labels"),
        F.count_if(size == 0).alias("skipped_count"),
    )
    classified = F.greatest(F.col("total_comments") - F.col("skipped_count"), F.lit(1))
    return totals.withColumn("avg_labels", ratio(F.col("total_labels"), classified))


def category_counts(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Assignments per label, known or not."""
    return (
        df.select(F.explode(labels_col).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
    )


def category_summary(
    df: DataFrame, categories: Sequence[str], labels_col: str = "labels"
) -> DataFrame:
    """Rows per known category with its share of all rows; unused categories show 0.

    One pass over the rows: a null label put in front of every row's labels counts the rows. Only
    aggregated, category-sized tables meet in the window and the join; the filter on the fixed
    list runs before them, so unknown labels cannot make them grow.
    """
    no_label = F.array(F.lit(None).cast("string"))
    labels = F.coalesce(F.col(labels_col), F.array().cast("array<string>"))
    counts = (
        df.select(F.explode(F.concat(no_label, labels)).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
        .filter(F.col("category").isNull() | F.col("category").isin(list(categories)))
    )
    rows = F.max(F.when(F.col("category").isNull(), F.col("n"))).over(Window.partitionBy())
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        category_table(df.sparkSession, categories)
        .join(counts.withColumn("rows", rows), "category", "left")
        .select(
            F.col("idx").cast("bigint").alias("idx"),
            "category",
            n.alias("n"),
            percent(n, F.col("rows")).alias("pct"),
        )
    )


def top_categories(summary: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most used categories, ties in category order, unused ones hidden.

    The unpartitioned window only sees the category list.
    """
    place = F.row_number().over(Window.orderBy(F.desc("n"), "idx"))
    return (
        summary.filter(F.col("n") > 0)
        .orderBy(F.desc("n"), "idx")
        .limit(k)
        .select(place.cast("bigint").alias("rank"), "category", "n", "pct")
    )


def file_results(
    df: DataFrame, file_col: str = "source_file", listing: DataFrame | None = None
) -> DataFrame:
    """One row per file: rows, processed, skipped, status.

    ``listing`` holds every file that was handed in; files without rows only exist there and
    come out as failed.
    """
    per_file = skip_totals(df, [file_col])
    if listing is not None:
        per_file = listing.select(file_col).join(per_file, file_col, "left")
    rows = F.coalesce(F.col("total_rows"), F.lit(0))
    skipped = F.coalesce(F.col("skipped"), F.lit(0))
    return per_file.select(
        file_col,
        F.when(rows > 0, "ok").otherwise("failed").alias("status"),
        rows.alias("total_rows"),
        (rows - skipped).alias("processed"),
        skipped.alias("skipped"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over ``file_results``."""
    ok = F.count_if(F.col("status") == "ok")
    return results.agg(
        F.count("*").alias("total_files"),
        ok.alias("successful_files"),
        (F.count("*") - ok).alias("failed_files"),
        percent(ok, F.count("*")).alias("success_rate"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed_comments"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_comments"),
    )
