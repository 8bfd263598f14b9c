"""Classifying files as they arrive, with running counters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.text import EMPTY
from ..operators.model import LabelModel, score, score_rows, with_predictions
from ..operators.triage import with_skip_reason
from .arrivals import take_csv

COUNTER_PARTITIONS = 4


def read_arriving(
    spark: SparkSession,
    folder: str,
    schema: str,
    kind: str = "parquet",
    files_per_trigger: int = 100,
    pattern: str | None = None,
    **options: str,
) -> DataFrame:
    """A stream of rows. CSV binds columns by position, so it is refused: see ``classify_arriving_csv``.

    ``pattern`` picks the entries of ``folder`` that are read; an entry is a file, or a folder with all its files.
    """
    if kind == "csv":
        raise ValueError("arriving CSV files are bound by header name: use classify_arriving_csv")
    reader = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .options(**options)
    )
    if pattern:
        # The braces make any name a glob: Spark takes a plain path for a folder and refuses a single file.
        folder = f"{folder.rstrip('/')}/{{{pattern}}}"
    return reader.format(kind).load(folder)


def _write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """A retried batch replaces its own folder, so every row is written exactly once."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def classify_arriving(
    stream: DataFrame,
    model: LabelModel,
    key: str,
    output: str,
    checkpoint: str,
    text_col: str = "text",
    null_reason: str = EMPTY,
    threshold: float = 0.5,
) -> StreamingQuery:
    """Score each micro-batch with the batch plan and append it below ``output``.

    The sum over a row's tokens is an aggregation; inside ``foreachBatch`` it is finished within
    the micro-batch and needs no state.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = with_predictions(
            score(batch, model, key, text_col, null_reason), model, threshold
        )
        _write_batch(scored, output, batch_id)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def classify_arriving_csv(
    spark: SparkSession,
    folder: str,
    model: LabelModel,
    output: str,
    checkpoint: str,
    text_col: str = "text",
    null_reason: str = EMPTY,
    threshold: float = 0.5,
    files_per_trigger: int = 100,
    ledger: str | None = None,
) -> StreamingQuery:
    """Score CSV files as they arrive, each bound by its own header.

    The stream carries the names of the new files; a micro-batch takes them with ``arrivals.take_csv``. A file
    that has gone, can't be read or lacks the column, and records with more fields than their header, are
    kept in ``ledger`` (by default ``<output>-ledger``) and don't stop the stream.
    """
    book = ledger or f"{output.rstrip('/')}-ledger"
    names = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path")
    )

    def scored(rows: DataFrame) -> DataFrame:
        return with_predictions(score_rows(rows, model, text_col, null_reason), model, threshold)

    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(row["path"] for row in batch.collect())
        take_csv(batch.sparkSession, paths, batch_id, text_col, scored, output, book)

    return (
        names.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    text_col: str = "text",
    null_reason: str = EMPTY,
) -> StreamingQuery:
    """Running number of rows per skip reason: at most five keys of state.

    Each micro-batch writes the whole counter table; ``latest_counts`` reads the last one.
    """
    counts = (
        with_skip_reason(stream, text_col, null_reason)
        .groupBy("skip_reason")
        .agg(F.count("*").alias("n"))
    )
    return _write_counters(counts, output, checkpoint)


def running_category_counts(
    stream: DataFrame, output: str, checkpoint: str, labels_col: str = "labels"
) -> StreamingQuery:
    """Running number of rows per category of an already labelled stream."""
    counts = (
        stream.select(F.explode(labels_col).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
    )
    return _write_counters(counts, output, checkpoint)


def _write_counters(counts: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Counter keys are few and pre-aggregated per task, so a few state partitions carry them.

    A query takes its number of state partitions from the session when it first starts.
    """
    spark = counts.sparkSession
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", COUNTER_PARTITIONS)
    try:
        return (
            counts.writeStream.outputMode("complete")
            .foreachBatch(lambda batch, batch_id: _write_batch(batch.coalesce(1), output, batch_id))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def latest_counts(spark: SparkSession, output: str) -> DataFrame:
    """The counter table after the last finished micro-batch; only that one is read.

    The listing shows finished files alone: a batch that is being written has hidden ones.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(output).select("path")
    batch = F.regexp_extract("path", r"/batch=([0-9]+)/[^/]*$", 1).cast("bigint")
    last = names.agg(F.max(batch)).first()[0]
    return spark.read.parquet(f"{output.rstrip('/')}/batch={last}")


class ProgressLog(StreamingQueryListener):
    """Input rows of every micro-batch of every query that runs while the log listens.

    Spark itself keeps a bounded number of updates per query.
    """

    def __init__(self, spark: SparkSession):
        self.batches: dict[str, dict[int, int]] = {}
        self.ended: set[str] = set()
        self.spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        batches = self.batches.setdefault(str(event.progress.runId), {})
        batches[event.progress.batchId] = batches.get(event.progress.batchId, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def rows(self, query: StreamingQuery, wait_seconds: float = 30.0) -> list[tuple[int, int]]:
        """``(batch id, input rows)`` of a query that has ended; events arrive a little after it."""
        until = time.monotonic() + wait_seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the end of the query was not reported")
            time.sleep(0.05)
        return sorted(self.batches.get(str(query.runId), {}).items())

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def observed(df: DataFrame, name: str, report: Callable[[int], None] | None = None):
    """Batch counterpart: count the rows that pass through ``df`` while a job runs over it."""
    from pyspark.sql import Observation

    observation = Observation(name)
    watched = df.observe(observation, F.count(F.lit(1)).alias("rows"))

    def rows() -> int:
        seen = observation.get["rows"]
        if report is not None:
            report(seen)
        return seen

    return watched, rows
