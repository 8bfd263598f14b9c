"""Numbered entries of a log folder, each created once: the one step that publishes a table or a model.

Data is written to a folder of its own first and never changed. An entry ``<log>/00000000000000000007.json`` then
names it. Whoever creates a number owns it; everyone else takes the next one. Clocks play no part, and
a reader sees an entry whole or not at all.

On HDFS and other file systems with an atomic rename, an entry is written aside and renamed without
overwriting; on local disks it is linked. An object store needs a Hadoop connector whose rename does not
overwrite either.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_DIGITS = 20


def entry_name(number: int) -> str:
    return f"{number:0{_DIGITS}d}.json"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content; False, and nothing changed, where it exists already."""
    context = spark.sparkContext
    names = context._jvm.org.apache.hadoop.fs.Path
    target = names(path)
    aside = names(target.getParent(), f"_{uuid.uuid4().hex}")
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":
        return _link(target.toUri().getPath(), aside.toUri().getPath(), text)
    return _rename(spark, target, aside, text)


def _rename(spark: SparkSession, target, aside, text: str) -> bool:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    keep = context._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    paths = hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration())
    try:
        paths.rename(paths.makeQualified(aside), paths.makeQualified(target), keep)
    except Py4JJavaError:
        files.delete(aside, False)
        if files.exists(target):
            return False
        raise
    return True


def _link(target: str, aside: str, text: str) -> bool:
    with open(aside, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(aside, target)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(aside)


def _number(path: str) -> Column:
    """The number of an entry; null for any other file."""
    return F.regexp_extract(path, rf"(?:^|/)([0-9]{{{_DIGITS}}})\.json$", 1).try_cast("bigint")


def entries(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All entries with their ``version``; a log that does not exist yet has none, other files are passed over."""
    try:
        rows = spark.read.schema(schema).json(log).select("*", _number("_metadata.file_name").alias("version"))
        return rows.filter("version IS NOT NULL")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, version BIGINT")


def newest(spark: SparkSession, log: str) -> int:
    """The largest number in the log by listing alone; 0 for none."""
    try:
        names = spark.read.format("binaryFile").load(log).select(_number("path").alias("n"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return names.agg(F.max("n")).first()[0] or 0


def append_entry(spark: SparkSession, log: str, row: dict) -> int:
    """Give the row the next free number and return it."""
    text = json.dumps(row, ensure_ascii=False, sort_keys=True)
    if re.search(r"[\r\n]", text):
        raise ValueError("an entry is one line")
    number = newest(spark, log) + 1
    while not put_if_absent(spark, f"{log.rstrip('/')}/{entry_name(number)}", text):
        number += 1
    return number
