"""Row triage and the counters built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import percent, ratio
from ..functions.text import EMPTY, NONE, should_skip, skip_reason
from ..errors import KeyNotUniqueError, MissingColumnError, StrictInputError


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise MissingColumnError(f"missing column(s): {', '.join(missing)}")
    return df


def with_skip_reason(df: DataFrame, text_col: str = "text", null_reason: str = EMPTY) -> DataFrame:
    require_columns(df, [text_col])
    reason = skip_reason(F.col(text_col), null_reason, df.schema[text_col].dataType)
    return df.withColumn("skip_reason", reason)


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("skip_reason") == NONE)


def reason_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "skip_reason").agg(F.count("*").alias("n"))


def reason_share(df: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each skip reason inside each ``by`` value.

    The window runs over the aggregated table: at most five rows per group.
    """
    total = F.sum("n").over(Window.partitionBy(by))
    return reason_counts(df, [by]).withColumn("pct", percent(F.col("n"), total))


def skip_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, skipped rows and their rate, over the table or per group."""
    skipped = F.count_if(should_skip(F.col("skip_reason")))
    return df.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        skipped.alias("skipped"),
        ratio(skipped, F.count("*")).alias("empty_rate"),
    )


def per_file_skips(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Files with skipped rows, most skipped first."""
    totals = skip_totals(df, [file_col]).filter(F.col("skipped") > 0)
    return totals.select(
        file_col,
        "total_rows",
        "skipped",
        percent(F.col("skipped"), F.col("total_rows")).alias("skipped_pct"),
    ).orderBy(F.desc("skipped"), file_col)


def strict_facts(df: DataFrame, text_col: str = "text", max_length: int = 5000) -> DataFrame:
    """One row: rows, null texts, longest text and whether the strict rules hold."""
    require_columns(df, [text_col])
    text = F.col(text_col)
    facts = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(text.isNull()).alias("null_texts"),
        F.coalesce(F.max(F.length(text.cast("string"))), F.lit(0)).cast("bigint").alias("max_length"),
    )
    return facts.withColumn(
        "passed", (F.col("null_texts") == 0) & (F.col("max_length") <= max_length)
    )


def check_strict(df: DataFrame, text_col: str = "text", max_length: int = 5000) -> None:
    """Raise before any scoring if a text is null or longer than ``max_length``."""
    facts = strict_facts(df, text_col, max_length).first()
    if facts["null_texts"]:
        raise StrictInputError(f"{facts['null_texts']} null value(s) in column {text_col!r}")
    if facts["max_length"] > max_length:
        raise StrictInputError(
            f"longest text has {facts['max_length']} characters, limit is {max_length}"
        )


def check_key(df: DataFrame, key: str) -> int:
    """Number of rows; a null or repeated key is refused, whatever the size of the table."""
    require_columns(df, [key])
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    facts = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("most"),
        F.count_if(F.col(key).isNull()).alias("nulls"),
    ).first()
    if facts["nulls"]:
        raise KeyNotUniqueError(f"column {key!r} has null values")
    if facts["most"] > 1:
        raise KeyNotUniqueError(f"column {key!r} repeats a value {facts['most']} times")
    return facts["rows"]
