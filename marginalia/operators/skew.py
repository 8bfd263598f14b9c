"""Joining rows to a keyed table when some keys are far more frequent than others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import all_named

HEAVY_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def table_bytes(df: DataFrame, fixed: int, *texts: str) -> int:
    """Upper estimate of the size of a small-row table: ``fixed`` bytes per row plus its texts."""
    variable = F.lit(0)
    for name in texts:
        variable = variable + F.coalesce(F.octet_length(name), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.sum(variable.cast("bigint")).alias("b")).first()
    return row["n"] * fixed + (row["b"] or 0)


def left_join_by_frequency(
    rows: DataFrame,
    keyed: DataFrame,
    key: str,
    frequency: str,
    keyed_bytes: int,
    fixed_bytes: int,
    heavy_rows: int = HEAVY_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``rows`` left-joined to ``keyed`` (one row per key) on ``key``.

    A ``keyed`` table whose measured ``keyed_bytes`` (see ``table_bytes``) are within
    ``broadcast_bytes`` is broadcast whole; ``fixed_bytes`` is what a row takes besides its key.
    A larger one is cut by
    ``frequency``, the number of rows that carry a key: keys with at least
    ``total / heavy_rows`` rows are broadcast, and there can be no more than ``heavy_rows`` of
    those (their bytes are measured, too); the rest meets in a shuffle join in which no key is
    frequent. Nothing is dropped:
    the parts are complementary and are put back together with a union. Rows whose key is null
    match nothing and stay out of the shuffle.
    """
    if keyed_bytes <= broadcast_bytes:
        return rows.join(F.broadcast(keyed), key, "left")
    total = keyed.agg(F.sum(frequency)).first()[0] or 0
    bar = max(1, -(-total // heavy_rows))
    heavy = keyed.filter(F.col(frequency) >= bar)
    while table_bytes(heavy, fixed_bytes, key) > max(broadcast_bytes, BROADCAST_BYTES):
        bar *= 2
        heavy = keyed.filter(F.col(frequency) >= bar)
    with_key = rows.filter(F.col(key).isNotNull())
    light_rows = with_key.join(F.broadcast(heavy.select(key)), key, "left_anti")
    light = light_rows.join(keyed.filter(F.col(frequency) < bar).hint("merge"), key, "left")
    hot = with_key.join(F.broadcast(heavy), key, "inner")
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema if f.name != key]
    others = [c for c in rows.columns if c != key]
    unkeyed = rows.filter(F.col(key).isNull()).select(key, *all_named(others), *extra)
    return light.unionByName(hot).unionByName(unkeyed)
