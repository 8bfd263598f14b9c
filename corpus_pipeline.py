"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of ``documents``.

Defined results: a stage that gets no rows returns none; null texts have no language and go at the first
stage; rows without id are never dropped as copies or as contaminated; rows that repeat id and text are
one document; further columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import decontaminate, language_id, near_dedup, packing, queries as q, suffix_dedup
from marginalia.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose best language has less than this share is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; without labels nothing is rejected."""
    net = q.learnt_languages(docs)
    if net is None:
        return docs
    found = language_id.identify(docs, net)
    fine = (F.col("language") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(fine).select("row.*", "text").select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    found = near_dedup.near_duplicates(docs)
    dropped = materialise(found.filter("NOT kept AND doc IS NOT NULL").select(F.col("doc").alias("doc_id")), "copies")
    left = docs.join(dropped.distinct(), "doc_id", "left_anti").select(*_columns(docs))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also start earlier."""
    found = suffix_dedup.repeated_spans(docs, as_text=True)
    rest = found.select("row.*", F.col("doc").alias("doc_id"), F.col("kept").alias("text"))
    rest = rest.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rest
    return rest.select(*_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages."""
    found = decontaminate.contamination(docs, q.table(spark, sf_dir, "benchmark"))
    hit = q.decontamination_columns(found).filter("contaminated AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(materialise(hit, "contaminated").distinct(), "doc_id", "left_anti").select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return q.packed_columns(packing.pack(docs, q.tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language identification and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
