"""Column references that survive any column name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def named(name: str) -> Column:
    """The column called exactly ``name``, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_named(names: Iterable[str]) -> list[Column]:
    return [named(name) for name in names]
