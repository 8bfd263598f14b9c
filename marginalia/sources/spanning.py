"""CSV files whose quoted fields run over line ends, read by many tasks.

Spark cuts such a file nowhere, because a line end may lie in a field. Here the lines of all parts of the file
are read as text, and each part finds out what its lines do to the state (outside or inside a quoted field) without knowing the state
it starts in. A line leads from either state to either: it keeps the state, swaps it, or ends in one
state whatever came before. Such steps compose, so a part's lines have states that are known or relative to its start, and the
parts' own steps, composed in the order of the file, give every part its true start. The lines of a record
that one task reads are put together there; only records cut by the end of a task's lines are gathered, from their pieces. The records are parsed by
Spark's own CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialise

# A field that starts with a quote and is closed; what follows its closing quote up to the comma belongs to it, as in Spark's parser.
# Possessive, so that a long field is matched in a loop and not by recursion.
_QUOTED = r'(^|,)"(?:[^"]++|"")*+"[^,]*+'
_OPEN = r'(^|,)"'


def _leaves_open(line: Column) -> Column:
    """Is a quoted field open at the end of a line that starts outside of one?"""
    return F.regexp_replace(line, _QUOTED, "$1").rlike(_OPEN)


def n_fields(record: Column) -> Column:
    """Fields of a record: commas outside of quoted fields, and one."""
    return F.regexp_count(F.regexp_replace(record, _QUOTED, "$1"), F.lit(",")) + 1


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines that end with a line feed only; everything else stays as it is, so records can be put together again."""
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(list(paths))


def files_with_returns(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """The paths of files in which a carriage return stands elsewhere than before a line feed."""
    if not paths:
        return set()
    lines = _lines(spark, paths).select("value", F.col("_metadata.file_path").alias("path"))
    # Row metadata spells a path as an encoded URI; paths are compared as they can be opened.
    found = lines.filter(F.col("value").rlike("\r(?!$)")).select(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    alone = {_bare(r["path"]) for r in found.distinct().collect()}
    return {p for p in paths if _bare(p) in alone}


def _bare(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def lines_with_steps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file_path, block, from_out, from_in, value)``: each line, and whether it ends inside a quoted field from either state."""
    value = F.col("value")
    quoted = F.contains(value, F.lit('"'))
    return _lines(spark, paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        (quoted & _leaves_open(value)).alias("from_out"),
        (~quoted | _leaves_open(F.concat(F.lit('"'), value))).alias("from_in"),
        value.cast("binary").alias("value"),  # Arrow's strings must be valid UTF-8, these need not be
    )


def _with_states(lines: DataFrame) -> DataFrame:
    """``(file_path, block, line, before, after, value)``, lines numbered within their block.

    States are 0 outside and 1 inside a quoted field; 2 is the state in which the block starts, 3 the other one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, line = None, 2, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int8) for i in (2, 3))
            names = files.dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            before, after = np.empty(batch.num_rows, np.int8), np.empty(batch.num_rows, np.int8)
            numbers = np.empty(batch.num_rows, np.int64)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                key = (files[low].as_py(), int(blocks[low]))
                if key != current:
                    current, state, line = key, 2, 0
                own, other = a[low:high], b[low:high]
                swaps = np.cumsum(own & (other ^ 1))
                known = np.maximum.accumulate(np.where(own == other, np.arange(high - low), -1))
                since = (swaps - np.where(known >= 0, swaps[known], 0)) & 1
                ends = np.where(known >= 0, own[known], state) ^ since
                after[low:high] = ends
                before[low], before[low + 1 : high] = state, ends[:-1]
                numbers[low:high] = line + np.arange(high - low)
                state, line = int(ends[-1]), line + high - low
            yield pa.RecordBatch.from_arrays(
                [files, batch.column(1), pa.array(numbers), pa.array(before), pa.array(after), batch.column(4)],
                ["file_path", "block", "line", "before", "after", "value"],
            )

    return lines.mapInArrow(run, "file_path string, block long, line long, before byte, after byte, value binary")


def _starts(lines: DataFrame) -> DataFrame:
    """``(file_path, block, start)``: the true state, 0 or 1, at the start of every block."""
    steps = lines.groupBy("file_path", "block").agg(F.max_by("after", "line").alias("step"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    until = earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = F.sum((F.col("step") == 3).cast("int"))
    steps = steps.withColumn("swaps", swaps.over(until))
    known = F.last(F.when(F.col("step") < 2, F.struct("step", "swaps")), ignorenulls=True).over(earlier)
    steps = steps.withColumns({"swapped": F.coalesce(swaps.over(earlier), F.lit(0)), "known": known})
    start = F.when(F.col("known").isNull(), F.col("swapped") % 2).otherwise(
        (F.col("known.step") + F.col("swapped") - F.col("known.swaps")) % 2
    )
    return steps.select("file_path", "block", start.cast("int").alias("start"))


def _assembled(lines: DataFrame) -> DataFrame:
    """``(file_path, block, line, begun, ended, record)``: lines that follow each other put together, by the place of the first one.

    A record whose lines a task reads one after the other comes out whole, both ``begun`` and ``ended``. Where a task's lines begin
    or end within a record, its piece comes out. Any order of the lines is right, only then there are more pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "block", "line", "begun", "ended", "record"]
        waiting, texts, last = None, [], None  # the place of an open record, its texts so far, the place of the last line

        def closed(ended: bool) -> pa.RecordBatch:
            row = [*waiting, ended, b"\n".join(texts)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            files, coded = batch.column(0), batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            blocks, lines_of, before, after = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            starts = before == 0
            starts[1:] |= (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]) | (lines_of[1:] != lines_of[:-1] + 1)
            follows = waiting is not None and not starts[0] and (files[0].as_py(), int(blocks[0]), int(lines_of[0]) - 1) == last
            if waiting is not None and not follows:
                yield closed(False)
                waiting = None
            starts[0] = True
            at = np.flatnonzero(starts)
            ends = np.append(at[1:], batch.num_rows)
            ended = after[ends - 1] == 0
            record = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows), pa.int32()), batch.column(5)), b"\n")
            low, high = 0, len(at)
            if follows:
                texts.append(record[0].as_py())
                low = 1
                if ended[0] or high > 1:
                    yield closed(bool(ended[0]))
                    waiting = None
            if high > low and not ended[-1]:
                high -= 1
                waiting = (files[int(at[-1])].as_py(), int(blocks[at[-1]]), int(lines_of[at[-1]]), bool(before[at[-1]] == 0))
                texts = [record[high].as_py()]
            if high > low:
                at, ended = at[low:high], ended[low:high]
                place = [files.take(pa.array(at)), pa.array(blocks[at]), pa.array(lines_of[at])]
                yield pa.RecordBatch.from_arrays([*place, pa.array(before[at] == 0), pa.array(ended), record.slice(low, high - low)], names)
            last = (files[batch.num_rows - 1].as_py(), int(blocks[-1]), int(lines_of[-1]))
        if waiting is not None:
            yield closed(False)

    ordered = lines.select("file_path", "block", "line", "before", "after", "value")
    found = ordered.mapInArrow(run, "file_path string, block long, line long, begun boolean, ended boolean, record binary")
    return found.withColumn("record", F.col("record").cast("string"))


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file_path, block, line, record)``: every record of the files as text, with the place of its first line.

    The lines are written once, so that their numbers hold. A record is one value: a quote that is never closed makes
    the rest of its file one record, as for any reader.
    """
    lines = materialise(_with_states(lines_with_steps(spark, paths)), "csv-lines")
    starts = materialise(_starts(lines), "csv-blocks")

    def true(state: str) -> Column:
        known = F.when(F.col(state) < 2, F.col(state)).otherwise(F.col(state).bitwiseXOR(F.col("start")).bitwiseAND(1))
        return known.cast("byte")

    found = _assembled(lines.join(starts, ["file_path", "block"]).withColumns({"before": true("before"), "after": true("after")}))
    whole = F.col("begun") & F.col("ended")
    # The pieces of a record are dealt by the place of its first line: that of the last piece before them that began one.
    earlier = Window.partitionBy("file_path").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.last(F.when(F.col("begun"), F.struct("block", "line")), ignorenulls=True).over(earlier)
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "record")))
    joined = (
        found.filter(~whole)
        .withColumn("first", begins)
        .groupBy("file_path", "first")
        .agg(pieces.alias("pieces"))
        .select("file_path", "first.block", "first.line", F.array_join("pieces.record", "\n").alias("record"))
    )
    return found.filter(whole).select("file_path", "block", "line", "record").unionByName(joined)


def read_spanning(
    spark: SparkSession, paths: Sequence[str], schema: str, options: dict[str, str], charset: str, names: Sequence[str]
) -> DataFrame:
    """``(_path, names...)`` of files that share a header, which is the first record of each."""
    found = records(spark, paths).filter("NOT (block = 0 AND line = 0)")
    record = F.col("record") if charset == "UTF-8" else F.decode(F.col("record").cast("binary"), charset)
    record = F.regexp_replace(record, "\r$", "")
    options = {k: v for k, v in options.items() if k != "header"} | {"multiLine": "true"}
    parsed = found.select("file_path", record.alias("record")).filter("record != ''")
    parsed = parsed.select(F.col("file_path").alias("_path"), F.from_csv("record", F.lit(schema), options).alias("row"))
    return parsed.select("_path", *[F.col("row").getField(n).alias(n) for n in names])
