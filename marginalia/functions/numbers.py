"""Numeric expressions shared by reports and scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def reaches(probability: Column, threshold: float = 0.5) -> Column:
    return probability >= F.lit(float(threshold))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))
