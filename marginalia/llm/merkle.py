"""Merkle manifest of a dataset: per level, fixed-offset lag and lead columns over windows of one run.

Every row is a leaf, the digest of its fields. Within a group (a source) the leaves stand in order; while a group has
several nodes, ``FAN`` consecutive ones (a run) become their parent. What remains of each group is its
subroot; the subroots, in order of their groups, give the root in the same way.

A level is a table of nodes with their places. The window is a run, ``(group, run)``: ``FAN - 1`` lag columns, masked by
the node's slot, are its siblings to the left, as many lead columns, masked by the length of the run, those to the
right, and in the first child's row the digest of them all is the parent. A window holds ``FAN`` narrow rows whatever
the size of its group, so a group with a third of all rows is spread like any other. A place is the offset of the group's rows in a sorted part plus the rows of
earlier parts: the table is sorted by ranges, in which the order within the group takes part, and only the counts
of ``(group, part)`` are ranked. Levels shrink by ``FAN``; all but the leaves' are written with their siblings. A row's path is its own siblings and its parent's path, joined
from the root downwards on the same ``(group, run)``; the leaves' paths are made in the row and never written.

Defined results: null fields are ``-``; a null group is a group of its own and comes first; null order values come first; equal
order values are ordered by leaf, equal leaves are rows of their own whose order does not matter; a lone leaf is its
group's subroot, a lone subroot the root; an empty table has no rows and no root; empty and very long texts are
fields like others; columns that are no fields are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; null parts count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Mapping[str, Column] | None = None, names: tuple[str, ...] = FIELDS) -> Column:
    """Digest of the fields ``names``; ``fields`` replaces some of them."""
    fields = fields or {}
    return digest(*[encoded(fields.get(n, F.col(f"`{n}`"))) for n in names])


def group_key(group: Column) -> Column:
    """A string that is never null, in the order of the groups with null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``idx``, the place within ``key`` by ``order``, and ``n``, the number of rows of the key.

    ``key`` is not null. Rows that are equal in everything are spread over the ranges, too.
    """
    whole = rows.withColumn("tie", F.monotonically_increasing_id())
    whole = whole.orderBy(F.col("key"), *order, F.col("tie")).drop("tie")
    whole = whole.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    whole = materialise(whole, "merkle-order")
    parts = whole.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    totals = parts.withColumn("n", F.sum("rows").over(Window.partitionBy("key"))).drop("rows")
    found = whole.join(totals, ["key", "part"])
    return found.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``run``, the siblings ``left`` and ``right`` (digests one after the other) and, in the first child's row, ``parent``.

    The only node of a key has no siblings and stays what it is: its ``parent`` is itself.
    """
    placed_nodes = nodes.selectExpr("*", f"idx DIV {FAN} AS run", f"idx % {FAN} AS slot")
    # One text for all columns, which is parsed faster than thirty expressions are built.
    window = "OVER (PARTITION BY key, run ORDER BY idx)"
    left = [f"IF(slot >= {k}, lag(hash, {k}) {window}, NULL)" for k in range(FAN - 1, 0, -1)]
    right = [f"IF(slot + {k} < least({FAN}, n - run * {FAN}), lead(hash, {k}) {window}, NULL)" for k in range(1, FAN)]
    near = placed_nodes.selectExpr("*", f"concat_ws('', {', '.join(left)}) AS left", f"concat_ws('', {', '.join(right)}) AS right")
    parent = F.when(F.col("n") == 1, F.col("hash")).otherwise(digest(F.col("hash"), F.col("right")))
    return near.withColumn("parent", F.when(F.col("slot") == 0, parent)).drop("slot")


def parents(nodes: DataFrame) -> DataFrame:
    first = nodes.filter(F.col("parent").isNotNull())
    n = F.ceil(F.col("n") / FAN).cast("long")
    return first.select("key", F.col("run").alias("idx"), n.alias("n"), F.col("parent").alias("hash"))


def heights(most: int) -> int:
    """Levels above the leaves of a group of ``most`` rows."""
    n = 0
    while most > 1:
        most, n = -(-most // FAN), n + 1
    return n


def levels_above(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The written levels above ``nodes``; in the last one every key has a single node."""
    levels = []
    for _ in range(heights(most)):
        nodes = materialise(with_siblings(parents(nodes if levels else with_siblings(nodes))), "merkle-level")
        levels.append(nodes)
    return levels


def no_path() -> Column:
    return F.expr("CAST(array() AS array<struct<left: string, right: string>>)")


def _step() -> Column:
    """The node's own siblings as the first step of its path."""
    return F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(no_path())


def paths_down(nodes: DataFrame, above: DataFrame, *keep: str) -> DataFrame:
    """``(key, idx, path, subroot, root)`` and the columns ``keep`` of ``nodes`` with siblings, from the paths of their parents."""
    above = above.select("key", F.col("idx").alias("run"), F.col("path").alias("above"), "subroot", "root")
    joined = nodes.join(above, ["key", "run"])
    return joined.select("key", "idx", F.concat(_step(), F.col("above")).alias("path"), "subroot", "root", *keep)


def fold(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf_hash, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass
class Manifest:
    leaves: DataFrame  # (key, hash, n, idx) and what was kept
    levels: list[DataFrame]
    groups: DataFrame  # (key, subroot, root, path), one row a group

    def proofs(self, *keep: str) -> DataFrame:
        """``(key, idx, path, subroot, root, hash)`` and the columns ``keep`` for every row.

        ``path`` lists the siblings to the left and right, level by level, from the leaf to the root.
        """
        above = self.groups.withColumn("idx", F.lit(0).cast("long"))
        for level in reversed(self.levels):
            above = paths_down(level, above)
        return paths_down(with_siblings(self.leaves), above, "hash", *keep)


def manifest(
    documents: DataFrame,
    names: tuple[str, ...] = FIELDS,
    group_col: str = "source",
    order_col: str = "doc_id",
    keep: Mapping[str, Column] | None = None,
) -> Manifest:
    """The tree over all rows; ``keep`` names further columns that go with the leaves (none named as the manifest's)."""
    extra = [c.alias(name) for name, c in (keep or {}).items()]
    rows = documents.select(
        group_key(F.col(f"`{group_col}`")).alias("key"), F.col(f"`{order_col}`").alias("ord"), leaf(names=names).alias("hash"), *extra
    )
    order = [F.col("ord").asc_nulls_first(), F.col("hash"), *[F.col(name) for name in (keep or {})]]
    leaves = materialise(placed(rows, order).drop("ord"), "merkle-leaves")
    levels = levels_above(leaves, leaves.agg(F.max("n")).first()[0] or 0)
    top = (levels[-1] if levels else leaves).select("key", F.col("hash").alias("subroot"))
    # The same once more over the subroots, as the rows of one group.
    subroots = top.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("subroot").alias("hash"))
    subroots = materialise(placed(subroots, [F.col("group")]), "merkle-subroots")
    upper = levels_above(subroots, subroots.agg(F.max("n")).first()[0] or 0)
    root = (upper[-1] if upper else subroots).select("key", F.col("hash").alias("root"))
    above = root.select("key", F.lit(0).cast("long").alias("idx"), no_path().alias("path"), F.lit("").alias("subroot"), "root")
    for level in reversed(upper):
        above = paths_down(level, above)
    found = paths_down(with_siblings(subroots), above, "group", "hash")
    groups = found.select(F.col("group").alias("key"), F.col("hash").alias("subroot"), "root", "path")
    return Manifest(leaves, levels, materialise(groups, "merkle-groups"))
