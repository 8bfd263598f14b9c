"""Tables that are replaced while others read them: immutable data folders and a log of versions.

``<path>/data/<id>`` holds the files of one version, ``<path>/log/<number>.json`` names it. A version counts
from the moment its entry exists: a writer that dies earlier leaves a folder nobody reads, and at no
moment is there no table. Readers keep the version they resolved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.files import CSV_OPTIONS
from .commits import append_entry, entries
from .tables import flat, writer_of

LOG_SCHEMA = "id STRING, kind STRING, columns STRING"


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/log"


def _data(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/data/{name}"


def publish(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """Write the next version of the table and make it the current one; returns its number."""
    name = uuid.uuid4().hex
    table = flat(df) if kind == "csv" else df
    writer_of(table, kind).save(_data(path, name))
    return append_entry(df.sparkSession, _log(path), {"id": name, "kind": kind, "columns": table.schema.json()})


def history(spark: SparkSession, path: str) -> DataFrame:
    """``(id, kind, columns, version)`` of every published version."""
    return entries(spark, _log(path), LOG_SCHEMA)


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of the table, or the one asked for."""
    known = history(spark, path)
    row = (known.orderBy("version", ascending=False) if version is None else known.filter(known["version"] == version)).first()
    if row is None:
        raise FileNotFoundError(f"no version {'at all' if version is None else version} of {path}")
    reader = spark.read.format(row["kind"]).schema(StructType.fromJson(json.loads(row["columns"])))
    if row["kind"] == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine="true")
    return reader.load(_data(path, row["id"]))


def drop_versions(spark: SparkSession, path: str, keep: Sequence[int]) -> int:
    """Delete the data of published versions other than ``keep``; folders without an entry stay, as
    their writers may be at work. Returns how many folders were deleted; their entries stay, too."""
    context = spark.sparkContext
    names = context._jvm.org.apache.hadoop.fs.Path
    files = names(path).getFileSystem(context._jsc.hadoopConfiguration())
    old = [r["id"] for r in history(spark, path).collect() if r["version"] not in set(keep)]
    return sum(bool(files.delete(names(_data(path, name)), True)) for name in old)
