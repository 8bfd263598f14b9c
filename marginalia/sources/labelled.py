"""Reading a labelled table in any of the three label layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import all_named
from ..operators.labels import labelled_table
from .files import SURPLUS, read_tables


def read_labelled(
    spark: SparkSession,
    paths: Sequence[str],
    text_col: str = "text",
    labels_col: str = "labels",
    keep: Sequence[str] = (),
    surplus_col: str | None = None,
) -> DataFrame:
    """``(keep..., text, labels ARRAY<STRING>)`` from labelled files.

    A CSV record with more fields than its header has labels that no column takes. The job that reads it fails and
    shows it; with ``surplus_col`` the record is given out in that column instead (null elsewhere) and the labels
    are those that have a column.
    """
    out = surplus_col or SURPLUS
    rows = read_tables(spark, paths, text_col, surplus_col=out)
    table = labelled_table(rows, text_col, labels_col, [*keep, out])
    if surplus_col:
        return table
    message = F.concat(F.lit("more fields than the header has: "), F.substring(out, 1, 200))
    checked = F.when(F.col(out).isNotNull(), F.raise_error(message).cast("array<string>")).otherwise(F.col("labels"))
    return table.withColumn("labels", checked).select(*all_named([*keep, "text", "labels"]))
