"""Label layouts, label vocabulary and label statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..errors import MissingColumnError, VocabularyError
from ..functions.columns import all_named
from ..functions.labels import combine_cells, label_at, multi_hot, parse_label_cell
from ..functions.numbers import ratio
from ..session import materialise
from .position import with_positions
from .triage import require_columns

#: Column families that may be named by any of their members.
FAMILIES = ("label_*", "category_*")
_NUMBERED = re.compile(r"Category (?:.*\s)?([0-9]+)", re.DOTALL)


def numbered_category_columns(columns: Sequence[str]) -> list[str]:
    """``Category <...> N`` columns in the order of N."""
    found = {name: _NUMBERED.fullmatch(name) for name in columns}
    return sorted((name for name, match in found.items() if match), key=lambda name: int(found[name][1]))


def _matches(name: str, glob: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, glob.split("*"))), name, re.DOTALL) is not None


def label_glob(labels_col: str) -> str | None:
    """The glob that ``labels_col`` stands for: a wildcard is one, a member of a family names the family."""
    if "*" in labels_col:
        return labels_col
    return next((family for family in FAMILIES if _matches(labels_col, family)), None)


def with_label_array(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Add ``labels ARRAY<STRING>`` from whichever of the three layouts the table uses.

    Numbered category columns win over ``labels_col``; then name patterns; then one column.
    """
    numbered = numbered_category_columns(df.columns)
    if numbered:
        return df.withColumn("labels", combine_cells(numbered))
    glob = label_glob(labels_col)
    if glob is not None:
        matched = [name for name in df.columns if _matches(name, glob)]
        if not matched:
            raise MissingColumnError(f"no column matches {labels_col!r}")
        return df.withColumn("labels", combine_cells(matched))
    require_columns(df, [labels_col])
    return df.withColumn(
        "labels", parse_label_cell(F.col(labels_col), df.schema[labels_col].dataType)
    )


def labelled_table(
    df: DataFrame, text_col: str = "text", labels_col: str = "labels", keep: Sequence[str] = ()
) -> DataFrame:
    """Canonical ``(keep..., text, labels)``; a null text becomes ''."""
    require_columns(df, [text_col, *keep])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return with_label_array(df, labels_col).select(*keep, text.alias("text"), "labels")


def label_counts(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Samples per label; repeats inside one row count as often as they occur."""
    return (
        df.select(F.explode(labels_col).alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def ranked_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "label")


def rare_labels(counts: DataFrame, min_samples: int = 5) -> DataFrame:
    return counts.filter(F.col("n") < min_samples)


def imbalance(counts: DataFrame) -> DataFrame:
    """One row: number of labels, largest and smallest count, their ratio."""
    return counts.agg(
        F.count("*").alias("n_labels"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.min("n"), F.lit(0)).alias("least"),
        ratio(F.max("n"), F.min("n")).alias("ratio"),
    )


def distinct_labels(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    return df.select(F.explode(labels_col).alias("label")).filter("label IS NOT NULL").distinct()


def vocabulary(df: DataFrame, labels_col: str = "labels", limit: int | None = None) -> list[str]:
    """Sorted distinct labels, as the list that names the outputs of a model.

    A model holds one weight per token and label, so its labels fit the driver if it fits a task; more than
    ``limit`` values are refused, never cut. ``vocabulary_table`` numbers labels without the driver.
    """
    distinct = distinct_labels(df, labels_col)
    found = [row["label"] for row in (distinct if limit is None else distinct.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise VocabularyError(f"column {labels_col!r} holds more than {limit} different labels")
    return sorted(found)


def vocabulary_table(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """``(idx, label)`` of the sorted distinct labels, numbered by ranges: any number of labels, no list on the driver."""
    labels = materialise(distinct_labels(df, labels_col), "labels").withColumn("_all", F.lit(0))
    return with_positions(labels, "label", "_all").select(F.col("row_pos").cast("int").alias("idx"), "label")


def with_multi_hot(
    df: DataFrame, names: Sequence[str], labels_col: str = "labels", out: str = "labels_multi"
) -> DataFrame:
    return df.withColumn(out, multi_hot(F.col(labels_col), names))


def most_labels(df: DataFrame, labels_col: str = "labels") -> int:
    widest = F.coalesce(F.max(F.greatest(F.size(labels_col), F.lit(0))), F.lit(0))
    return df.agg(widest.alias("k")).first()["k"]


def labels_to_wide(
    df: DataFrame, labels_col: str = "labels", prefix: str = "Category ", k: int | None = None
) -> DataFrame:
    """Replace the label array by ``Category 1..k`` columns, '' where a row has fewer.

    ``k`` defaults to the longest array of the table, found by one aggregate.
    """
    if k is None:
        k = most_labels(df, labels_col)
    cells = [label_at(F.col(labels_col), i).alias(f"{prefix}{i + 1}") for i in range(k)]
    kept = [c for c in df.columns if c != labels_col]
    return df.select(*all_named(kept), *cells)
