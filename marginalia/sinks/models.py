"""Versioned model tables: ``<root>/model=<id>/{counts,weights}`` and an entry of ``<root>/meta`` each.

A model is published by its entry, whose number is its version. A number is given once and for good, whatever
the writers' clocks say; two writers never share a folder or a number.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.model import LabelModel
from .commits import append_entry, entries, newest

META_SCHEMA = (
    "id STRING, published STRING, saved_at STRING, labels ARRAY<STRING>, bias ARRAY<BIGINT>, "
    "alpha DOUBLE, min_documents INT, n_tokens BIGINT, token_bytes BIGINT, details STRING"
)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished version, with its number; a write without its entry was never completed."""
    return entries(spark, _meta(root), META_SCHEMA)


def latest_version(spark: SparkSession, root: str) -> int:
    """0 when nothing was saved yet."""
    return newest(spark, _meta(root))


def _meta(root: str) -> str:
    return f"{root.rstrip('/')}/meta"


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/model={name}"


def save_model(
    model: LabelModel, root: str, details: dict | None = None, at: datetime | None = None
) -> int:
    """Write the next version; earlier versions stay as they are. Returns the version number."""
    spark = model.weights.sparkSession
    name = uuid.uuid4().hex
    model.counts.write.parquet(f"{_folder(root, name)}/counts")
    model.weights.write.parquet(f"{_folder(root, name)}/weights")
    sizes = spark.read.parquet(f"{_folder(root, name)}/weights").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("b")
    ).first()
    now = datetime.now(timezone.utc)
    row = {
        "id": name,
        "published": f"{now:%Y%m%d_%H%M%S_%f}",
        "saved_at": f"{at or now:%Y%m%d_%H%M%S}",
        "labels": list(model.labels),
        "bias": [int(x) for x in model.bias],
        "alpha": float(model.alpha),
        "min_documents": model.min_documents,
        "n_tokens": sizes["n"],
        "token_bytes": sizes["b"],
        "details": json.dumps(details or {}, ensure_ascii=False, sort_keys=True),
    }
    return append_entry(spark, _meta(root), row)


def _version_row(spark: SparkSession, root: str, version: int | None):
    known = versions(spark, root)
    found = known.orderBy(F.desc("version")) if version is None else known.filter(F.col("version") == int(version))
    row = found.first()
    if row is None:
        raise FileNotFoundError(f"no model version {'at all' if version is None else version} under {root}")
    return row


def load_model(spark: SparkSession, root: str, version: int | None = None) -> LabelModel:
    """The newest version, or the one asked for."""
    row = _version_row(spark, root, version)
    folder = _folder(root, row["id"])
    return LabelModel(
        tuple(row["labels"]),
        tuple(row["bias"]),
        spark.read.parquet(f"{folder}/weights"),
        spark.read.parquet(f"{folder}/counts"),
        row["alpha"],
        row["min_documents"],
        row["n_tokens"],
        row["token_bytes"],
    )


def model_details(spark: SparkSession, root: str, version: int | None = None) -> dict:
    return json.loads(_version_row(spark, root, version)["details"])
