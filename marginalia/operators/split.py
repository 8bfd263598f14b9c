"""Reproducible shuffle and exact-count train / validation / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .triage import check_key

TEST = "test"
VALIDATION = "validation"
TRAIN = "train"

PREFIX_STEP = 3
DIRECT_PICK = 50_000


def shuffle_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _order(key: str, seed: int) -> Column:
    return F.struct(shuffle_hash(key, seed).alias("h"), F.col(key).alias("k"))


def _prefix_counts(rows: DataFrame, h: Column, width: int) -> list[tuple[str, int]]:
    counts = rows.groupBy(F.substring(h, 1, width).alias("p")).agg(F.count("*").alias("n"))
    return sorted((row["p"], row["n"]) for row in counts.collect())


def _nth(
    keys: DataFrame, key: str, seed: int, n: int, first_counts: list[tuple[str, int]]
) -> tuple:
    """The ``n``-th smallest (1-based) shuffled key.

    Counts per hash prefix say which prefix holds it; the prefix grows until few enough rows
    share it to sort them directly. Each round reads only the key column and sends one
    4096-row table to the driver, whatever the table size.
    """
    h = shuffle_hash(key, seed)
    counts, width, taken = first_counts, PREFIX_STEP, n
    while True:
        for prefix, size in counts:
            if taken <= size:
                break
            taken -= size
        rows = keys.filter(F.substring(h, 1, width) == prefix)
        if size <= DIRECT_PICK or width >= 32:
            break
        width += PREFIX_STEP
        counts = _prefix_counts(rows, h, width)
    found = rows.orderBy(_order(key, seed)).offset(taken - 1).limit(1).select(h.alias("h"), key).first()
    return found["h"], found[key]


def with_split(
    df: DataFrame,
    key: str,
    test_size: float = 0.1,
    valid_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: the first ``int(n * test_size)`` rows of the shuffled order are test, the
    next ``int(n * valid_size)`` validation, the rest train.

    Two cut points are found first, so that assigning the split is a projection: the rows are
    neither sorted, joined nor shuffled. ``key`` must identify the rows: null and repeated keys are
    refused.
    """
    keys = df.select(key)
    n = check_key(keys, key)
    counts = _prefix_counts(keys, shuffle_hash(key, seed), PREFIX_STEP)
    test_n, valid_n = int(n * test_size), int(n * valid_size)
    at = _order(key, seed)
    split = F.when(F.lit(False), F.lit(TRAIN))
    for name, until in ((TEST, test_n), (VALIDATION, test_n + valid_n)):
        if until:
            cut_hash, cut_key = _nth(keys, key, seed, until, counts)
            cut = F.struct(
                F.lit(cut_hash).alias("h"), F.lit(cut_key).cast(df.schema[key].dataType).alias("k")
            )
            split = split.when(at <= cut, name)
    return df.withColumn("split", split.otherwise(TRAIN))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The whole table in the seeded order (a distributed range sort)."""
    return df.orderBy(shuffle_hash(key, seed), key)
