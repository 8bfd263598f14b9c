"""Expressions over file paths and run stamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP_FORMAT = "yyyyMMdd_HHmmss"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def run_stamp(at: Column) -> Column:
    return F.date_format(at, STAMP_FORMAT)


def output_name(path: Column, prefix: str, stamp: Column) -> Column:
    return F.concat(F.lit(prefix), file_stem(path), F.lit("_"), stamp)
