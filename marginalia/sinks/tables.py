"""Result tables: whole-table writes, appends, run-stamped names, combined output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import named
from ..functions.files import output_name
from ..operators.labels import labels_to_wide
from ..sources.files import CSV_OPTIONS, union_by_name

CSV_WRITE_OPTIONS = {**CSV_OPTIONS, "emptyValue": '""'}


def writer_of(df: DataFrame, kind: str):
    writer = df.write.format(kind)
    return writer.options(**CSV_WRITE_OPTIONS) if kind == "csv" else writer


def flat(df: DataFrame, separator: str = "|") -> DataFrame:
    """CSV has no arrays: string arrays become delimited cells."""
    columns = []
    for field in df.schema:
        column = named(field.name)
        if field.dataType.typeName() == "array":
            column = F.array_join(column.cast("array<string>"), separator)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace the table at ``path``, all or nothing.

    The new table is written next to the old one and takes its place by renaming when it is
    complete; a write that fails leaves the old table as it was. Between the two renames there is
    no table for a moment: a table that others read while it is replaced goes to ``published.publish``.
    """
    target = path.rstrip("/")
    fresh, old = (f"{target}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    context = df.sparkSession.sparkContext
    names = context._jvm.org.apache.hadoop.fs.Path
    files = names(target).getFileSystem(context._jsc.hadoopConfiguration())
    try:
        writer_of(flat(df) if kind == "csv" else df, kind).save(fresh)
    except Exception:
        files.delete(names(fresh), True)
        raise
    replaced = files.exists(names(target))
    if replaced and not files.rename(names(target), names(old)):
        raise OSError(f"can't move {target} away; the new table is in {fresh}")
    if not files.rename(names(fresh), names(target)):
        raise OSError(f"can't move {fresh} to {target}")
    if replaced:
        files.delete(names(old), True)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer_of(flat(df) if kind == "csv" else df, kind).mode("append").save(path)


def stamp(at: datetime) -> str:
    return f"{at:%Y%m%d_%H%M%S}"


def run_path(folder: str, at: datetime) -> str:
    return f"{folder.rstrip('/')}/run_ts={stamp(at)}"


def save_per_file(
    df: DataFrame,
    folder: str,
    at: datetime,
    prefix: str = "classified_",
    path_col: str = "file_path",
    kind: str = "parquet",
) -> str:
    """One run-stamped output folder per input file, written by one job; returns the run's path.

    A folder is named by the file's name and, below that, by a digest of its whole path: files of
    equal names in different folders stay apart.

    The rebalance hint lets adaptive execution gather small files' rows and split the rows of a
    file that is much larger than the others over several writers.
    """
    stamped = df.withColumn("output", output_name(F.col(path_col), prefix, F.lit(stamp(at))))
    stamped = stamped.withColumn("file_id", F.substring(F.md5(F.col(path_col)), 1, 12))
    balanced = stamped.hint("rebalance", "output", "file_id")
    path = run_path(folder, at)
    writer = writer_of(flat(balanced) if kind == "csv" else balanced, kind)
    writer.mode("overwrite").partitionBy("output", "file_id").save(path)
    return path


def combined(parts: Sequence[tuple[str, DataFrame]], file_col: str = "source_file") -> DataFrame:
    """All parts as one table with the name of the origin in the first column."""
    named = [df.select(F.lit(name).alias(file_col), "*") for name, df in parts]
    return union_by_name(named)


def combined_path(folder: str, at: datetime, prefix: str = "classified_") -> str:
    return f"{folder.rstrip('/')}/{prefix}combined_{stamp(at)}"


def save_predictions(
    df: DataFrame, path: str, labels_col: str = "predicted", kind: str = "parquet"
) -> None:
    """Write predictions with their label array spread over ``Category 1..k`` columns."""
    save(labels_to_wide(df, labels_col), path, kind)

