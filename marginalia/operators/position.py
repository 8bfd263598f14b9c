"""Row positions and row-range chunks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .triage import check_key, require_columns

CHUNK_ROWS = 1000
#: Rows that one key range should hold, and the most ranges; the edges are literals in the plan.
RANGE_ROWS = 500_000
MOST_RANGES = 2000
#: Sampled keys per range, from which the edges are picked.
OVERSAMPLING = 20
#: Chunks that one step of the chunk table makes from a row.
CHUNKS_AT_ONCE = 10_000


def chunk_table(df: DataFrame, by: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(by, chunk, start_row, n_rows)`` for every row-range chunk, from counts alone.

    Chunk numbers are made in two steps, so no row holds more than ``CHUNKS_AT_ONCE`` of them.
    """
    chunk, block = F.col("chunk"), F.lit(CHUNKS_AT_ONCE).cast("bigint")
    zero = F.lit(0).cast("bigint")
    counted = df.groupBy(by).agg(F.count("*").alias("rows"))
    last = F.floor((F.col("rows") - 1) / F.lit(chunk_rows)).cast("bigint")
    blocks = counted.select(
        by, "rows", last.alias("last"), F.explode(F.sequence(zero, F.floor(last / block).cast("bigint"))).alias("b")
    )
    first = F.col("b") * block
    numbered = blocks.select(
        by, "rows", F.explode(F.sequence(first, F.least(first + block - 1, F.col("last")))).alias("chunk")
    )
    return numbered.select(
        by,
        "chunk",
        (chunk * chunk_rows).alias("start_row"),
        F.least(F.lit(chunk_rows), F.col("rows") - chunk * chunk_rows).cast("bigint").alias("n_rows"),
    )


def _bucket(key: Column, edges: list, first: int = 0) -> Column:
    """Number of edges at or below the key, as a balanced tree of comparisons.

    The edges are literals, so a recomputed task puts every row where it was before.
    """
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    below = _bucket(key, edges[:middle], first)
    above = _bucket(key, edges[middle + 1 :], first + middle + 1)
    return F.when(key < edges[middle], below).otherwise(above)


def _edges(df: DataFrame, key: str, rows: int, ranges: int) -> list:
    """Keys that cut the table into about equal ranges, from a sample by the hash of the key."""
    one_in = max(1, rows // (ranges * OVERSAMPLING))
    sample = df.select(key).filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)
    found = sorted(r[key] for r in sample.collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def with_positions(df: DataFrame, key: str, by: str, buckets: int | None = None) -> DataFrame:
    """Add ``row_pos``: the 0-based rank of ``key`` among the rows of its ``by`` value.

    ``key`` identifies the rows (null and repeated keys are refused) and is of any orderable type.
    The table is cut into ``buckets`` key ranges of about equal size (by default one per ``RANGE_ROWS`` rows),
    so the sorted groups are ``(by, range)`` and a ``by`` value that fills a third of the table is
    spread over a third of the ranges. Range sizes give the offset of each group.
    """
    require_columns(df, [key, by])
    rows = check_key(df, key)
    if not rows:
        return df.withColumn("row_pos", F.lit(0).cast("bigint"))
    ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS)) if buckets is None else buckets
    edges = [F.lit(e).cast(df.schema[key].dataType) for e in _edges(df, key, rows, ranges)]
    bucketed = df.withColumn("_bucket", _bucket(F.col(key), edges))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(by, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .select(
            F.col(by).alias("_by"),
            F.col("_bucket").alias("_in"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        )
    )
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_in"))
    in_bucket = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(key)) - 1
    return (
        bucketed.withColumn("_rank", in_bucket)
        .join(offsets, same)
        .withColumn("row_pos", (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_rank", "_offset", "_by", "_in")
    )


def with_chunks(
    df: DataFrame, key: str, by: str, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None
) -> DataFrame:
    """Add ``chunk``, the row-range chunk each row falls in within its ``by`` value."""
    return with_positions(df, key, by, buckets).withColumn(
        "chunk", F.floor(F.col("row_pos") / chunk_rows).cast("bigint")
    )
