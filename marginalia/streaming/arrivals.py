"""A durable ledger of files that arrive, and what could not be used of them.

Every micro-batch leaves three folders, in this order:

* ``<ledger>/records/batch=N``: records with more fields than their header, as they stand in the file;
* the batch's result, below the caller's output;
* ``<ledger>/files/batch=N``: one row per file with its status and its rows.

The last one, a single file, publishes the batch. A batch that is repeated after a crash replaces what
was not published, and leaves alone what was: every file is in the ledger once per attempt, every row of a good file once in the output.
A bad file is recorded and the stream goes on; ``retry_files`` takes bad files again after they were mended.
Spark leaves out files of no bytes, so they are not in the ledger; a file without records is ``no_data``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.files import file_name
from ..sources.files import NO_DATA, OK, SURPLUS, bare_path, csv_states, empty_comments, present_paths, read_csv
from ..session import materialise

FILES_SCHEMA = "file_path STRING, source_file STRING, status STRING, n_rows BIGINT, n_surplus BIGINT, recorded_at TIMESTAMP"
RECORDS_SCHEMA = "file_path STRING, source_file STRING, record STRING"
#: Attempts to take bad files again are numbered from here on; micro-batches count from 0.
RETRIES = 1 << 40


def _batch(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/batch={number}"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a folder with their number in ``batch``; none before the first one."""
    full = f"{schema}, batch BIGINT"
    try:
        return spark.read.schema(full).option("basePath", folder).parquet(f"{folder}/batch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def recorded_files(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per file and attempt, with the batch that took it."""
    return _read(spark, f"{ledger.rstrip('/')}/files", FILES_SCHEMA)


def dead_records(spark: SparkSession, ledger: str) -> DataFrame:
    """Records of published batches that have more fields than their header; no part of the output."""
    published = recorded_files(spark, ledger).select("batch").distinct()
    return _read(spark, f"{ledger.rstrip('/')}/records", RECORDS_SCHEMA).join(published, "batch", "left_semi")


def file_status(spark: SparkSession, ledger: str) -> DataFrame:
    """The last attempt at every file that ever arrived: progress of a run that survives restarts."""
    last = F.max_by(F.struct("source_file", "status", "n_rows", "n_surplus", "recorded_at", "batch"), "batch")
    tries = F.count("*").alias("attempts")
    return recorded_files(spark, ledger).groupBy("file_path").agg(last.alias("last"), tries).select("file_path", "last.*", "attempts")


def dead_files(spark: SparkSession, ledger: str) -> DataFrame:
    return file_status(spark, ledger).filter(~F.col("status").isin(OK, NO_DATA))


def progress(spark: SparkSession, ledger: str) -> DataFrame:
    """One row: files seen, good and bad, rows and surplus records taken so far."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    good = F.col("status").isin(OK, NO_DATA)
    return file_status(spark, ledger).agg(
        F.count("*").alias("files"),
        F.count_if(good).alias("good_files"),
        F.count_if(~good).alias("bad_files"),
        total("n_rows").alias("rows"),
        total("n_surplus").alias("surplus_records"),
    )


def published_rows(spark: SparkSession, output: str, ledger: str) -> DataFrame:
    """The output of all published batches; a batch that is being written is not among them."""
    numbers = sorted(r["batch"] for r in recorded_files(spark, ledger).select("batch").distinct().collect())
    paths = present_paths(spark, [_batch(output, n) for n in numbers])
    return spark.read.option("mergeSchema", "true").option("basePath", output).parquet(*paths)


def take_csv(
    spark: SparkSession,
    paths: Sequence[str],
    number: int,
    text_col: str,
    transform: Callable[[DataFrame], DataFrame],
    output: str,
    ledger: str,
) -> None:
    """Judge the files, write what ``transform`` makes of the good ones' rows, then publish the batch."""
    paths = sorted(set(paths))
    files, records = (_batch(f"{ledger.rstrip('/')}/{name}", number) for name in ("files", "records"))
    written = _batch(output, number)
    if not paths or _published(spark, files):
        return
    facts, states = csv_states(spark, paths, text_col)
    bad = {path for path, _ in states}
    good = [path for path in paths if path not in bad]
    if good and facts is not None:
        parsed = read_csv(spark, good, text_col, missing_text="skip", facts=facts, misfit_col=SURPLUS, surplus_only=True)
        rows = materialise(parsed, "arrived")
    else:
        rows = empty_comments(spark, text_col).withColumn(SURPLUS, F.lit(None).cast("string"))
    beyond = F.col(SURPLUS).isNotNull()
    rows.filter(beyond).select("file_path", "source_file", F.col(SURPLUS).alias("record")).write.mode("overwrite").parquet(records)
    transform(rows.filter(~beyond).drop(SURPLUS)).write.mode("overwrite").parquet(written)
    _write_files(spark, paths, states, written, records, files)


def _published(spark: SparkSession, files: str) -> bool:
    """Whether the batch's row of files is there: a writer that died leaves hidden files alone."""
    return bool(present_paths(spark, [files])) and not spark.read.schema(FILES_SCHEMA).parquet(files).isEmpty()


def _write_files(
    spark: SparkSession, paths: list[str], states: list[tuple[str, str]], written: str, records: str, target: str
) -> None:
    def counted(folder: str, name: str) -> DataFrame:
        return spark.read.parquet(folder).groupBy(bare_path(F.col("file_path")).alias("bare")).agg(F.count("*").alias(name))

    known = dict(states)
    arrived = spark.createDataFrame([(p, known.get(p)) for p in paths], "file_path STRING, state STRING")
    n_rows, n_surplus = (F.coalesce(name, F.lit(0)) for name in ("n_rows", "n_surplus"))
    (
        arrived.withColumn("bare", bare_path(F.col("file_path")))
        .join(counted(written, "n_rows"), "bare", "left")
        .join(counted(records, "n_surplus"), "bare", "left")
        .select(
            "file_path",
            file_name(F.col("file_path")).alias("source_file"),
            F.coalesce("state", F.when(n_rows + n_surplus == 0, NO_DATA).otherwise(OK)).alias("status"),
            n_rows.alias("n_rows"),
            n_surplus.alias("n_surplus"),
            F.current_timestamp().alias("recorded_at"),
        )
        .coalesce(1)
        .write.mode("overwrite")
        .parquet(target)
    )


def retry_files(
    spark: SparkSession,
    text_col: str,
    transform: Callable[[DataFrame], DataFrame],
    output: str,
    ledger: str,
    files_per_batch: int = 100,
) -> int:
    """Take the bad files again, one batch after the other; returns how many are good now.

    One caller at a time: a run that died is repeated under the same number.
    """
    waiting = sorted(r["file_path"] for r in dead_files(spark, ledger).select("file_path").collect())
    last = recorded_files(spark, ledger).agg(F.max("batch")).first()[0] or 0
    number = max(RETRIES, last + 1)
    for first in range(0, len(waiting), files_per_batch):
        take_csv(spark, waiting[first : first + files_per_batch], number, text_col, transform, output, ledger)
        number += 1
    return len(waiting) - dead_files(spark, ledger).count()


__all__ = [
    "dead_files",
    "dead_records",
    "file_status",
    "progress",
    "published_rows",
    "recorded_files",
    "retry_files",
    "take_csv",
]
