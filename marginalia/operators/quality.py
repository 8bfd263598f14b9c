"""Quality gates for labelled data, as tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import TrainingDataError
from ..functions.labels import split_on
from ..functions.text import is_blank, text_key
from .labels import combine_cells, imbalance, label_counts, numbered_category_columns
from .triage import require_columns

ERROR = "error"
WARNING = "warning"

SHORT_TEXT = 10
LONG_TEXT = 1000


def text_facts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of counts over the text column.

    Duplicates are rows minus distinct texts, null counting as one value. Distinct texts are
    counted on ``text_key`` so that long texts do not travel; Spark groups by that key with a
    map-side combine first, which absorbs a text that fills a large part of the table.
    """
    require_columns(df, [text_col])
    text = F.col(text_col)
    per_text = df.groupBy(text_key(text).alias("key")).agg(
        F.count("*").alias("rows"),
        F.count_if(text.isNull()).alias("nulls"),
        F.count_if(is_blank(text)).alias("blanks"),
        F.count_if(F.length(text) < SHORT_TEXT).alias("shorts"),
        F.count_if(F.length(text) > LONG_TEXT).alias("longs"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return per_text.agg(
        total("rows").alias("total_rows"),
        (total("rows") - F.count("*")).alias("duplicates"),
        total("nulls").alias("null_texts"),
        total("blanks").alias("blank_texts"),
        total("shorts").alias("short_texts"),
        total("longs").alias("long_texts"),
    )


def _rule(position: int, name: str, severity: str, observed: Column, limit: Column, passed: Column):
    return F.struct(
        F.lit(position).cast("bigint").alias("position"),
        F.lit(name).alias("rule"),
        F.lit(severity).alias("severity"),
        observed.cast("double").alias("observed"),
        limit.cast("double").alias("limit_value"),
        passed.alias("passed"),
    )


def _rules(facts: DataFrame, *rules) -> DataFrame:
    return facts.select(F.inline(F.array(*rules)))


def training_gate(
    df: DataFrame,
    text_col: str = "text",
    labels_col: str = "labels",
    min_rows: int = 50,
    min_per_label: int = 5,
    max_imbalance: float = 20.0,
    max_duplicate_share: float = 0.1,
    max_short_share: float = 0.2,
    facts: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rules in the order in which they are judged; the first failing error decides.

    ``facts`` and ``counts`` take the results of earlier ``text_facts`` and ``label_counts`` of the table.
    """
    rows = F.col("total_rows")
    duplicate_limit = rows * F.lit(max_duplicate_share)
    short_limit = rows * F.lit(max_short_share)
    on_text = _rules(
        text_facts(df, text_col) if facts is None else facts,
        _rule(1, "enough_rows", ERROR, rows, F.lit(min_rows), rows >= min_rows),
        _rule(2, "duplicates", WARNING, F.col("duplicates"), duplicate_limit,
              F.col("duplicates") <= duplicate_limit),
        _rule(3, "no_blank_text", ERROR, F.col("blank_texts"), F.lit(0), F.col("blank_texts") == 0),
        _rule(4, "short_texts", WARNING, F.col("short_texts"), short_limit,
              F.col("short_texts") <= short_limit),
    )
    if counts is None:
        counts = label_counts(_with_label_lists(df, labels_col), labels_col)
    rare = F.count_if(F.col("n") < min_per_label).alias("rare")
    spread = counts.agg(rare, *_imbalance_columns())
    on_labels = _rules(
        spread,
        _rule(5, "has_labels", ERROR, F.col("n_labels"), F.lit(1), F.col("n_labels") > 0),
        _rule(6, "enough_per_label", ERROR, F.col("rare"), F.lit(0), F.col("rare") == 0),
        _rule(7, "imbalance", WARNING, F.col("ratio"), F.lit(max_imbalance),
              F.col("ratio") <= max_imbalance),
    )
    return on_text.unionByName(on_labels)


def _imbalance_columns() -> list[Column]:
    return [
        F.count("*").alias("n_labels"),
        F.coalesce(F.max("n") / F.min("n"), F.lit(0.0)).alias("ratio"),
    ]


def _with_label_lists(df: DataFrame, labels_col: str) -> DataFrame:
    """The gate accepts label arrays, comma-separated strings and numbered category columns."""
    if labels_col in df.columns:
        if df.schema[labels_col].dataType.typeName() == "string":
            return df.withColumn(labels_col, split_on(F.col(labels_col), ","))
        return df
    columns = numbered_category_columns(df.columns)
    if not columns:
        require_columns(df, [labels_col])
    return df.withColumn(labels_col, combine_cells(columns))


def light_gate(
    df: DataFrame, text_col: str = "text", labels_col: str = "labels", min_rows: int = 10
) -> DataFrame:
    """Columns exist (checked at plan time), rows exist, no nulls, at least ``min_rows`` rows."""
    require_columns(df, [text_col, labels_col])
    facts = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(text_col).isNull()).alias("null_texts"),
        F.count_if(F.col(labels_col).isNull()).alias("null_labels"),
    )
    rows = F.col("total_rows")
    return _rules(
        facts,
        _rule(1, "not_empty", ERROR, rows, F.lit(1), rows > 0),
        _rule(2, "no_null_text", ERROR, F.col("null_texts"), F.lit(0), F.col("null_texts") == 0),
        _rule(3, "no_null_labels", ERROR, F.col("null_labels"), F.lit(0),
              F.col("null_labels") == 0),
        _rule(4, "enough_rows", ERROR, rows, F.lit(min_rows), rows >= min_rows),
    )


def first_failure(rules: DataFrame) -> DataFrame:
    """One row: whether the gate passes and the rule that stopped it, if any."""
    failed = F.when(
        (F.col("severity") == ERROR) & ~F.col("passed"), F.struct("position", "rule")
    )
    return rules.agg(F.min(failed).alias("stop")).select(
        F.col("stop").isNull().alias("is_valid"), F.col("stop.rule").alias("failed_rule")
    )


def enforce(rules: DataFrame) -> list[str]:
    """Raise on the first failing error; return the names of the warnings."""
    judged = sorted(rules.collect(), key=lambda row: row["position"])
    for row in judged:
        if row["severity"] == ERROR and not row["passed"]:
            raise TrainingDataError(
                f"rule {row['rule']}: observed {row['observed']:g}, limit {row['limit_value']:g}"
            )
    return [row["rule"] for row in judged if not row["passed"]]


def recommendations(df: DataFrame, text_col: str = "text", facts: DataFrame | None = None) -> DataFrame:
    """Advice that applies to the table: ``(position, advice, n)``. ``facts`` as in ``training_gate``."""
    rows = F.col("total_rows")

    def advice(position: int, name: str, n: Column, applies: Column) -> Column:
        return F.when(
            applies,
            F.struct(
                F.lit(position).cast("bigint").alias("position"),
                F.lit(name).alias("advice"),
                n.alias("n"),
            ),
        )

    found = F.array_compact(
        F.array(
            advice(1, "remove_duplicates", F.col("duplicates"), F.col("duplicates") > 0),
            advice(2, "review_short_texts", F.col("short_texts"), F.col("short_texts") > 0),
            advice(3, "review_long_texts", F.col("long_texts"), F.col("long_texts") > 0),
            advice(4, "small_dataset", rows, rows < 100),
            advice(5, "moderate_dataset", rows, (rows >= 100) & (rows < 500)),
        )
    )
    return (text_facts(df, text_col) if facts is None else facts).select(F.inline(found))


__all__ = [
    "enforce",
    "first_failure",
    "imbalance",
    "light_gate",
    "recommendations",
    "text_facts",
    "training_gate",
]
