"""The given tables, seen as comments, labelled texts and label cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the text of some replaced by '', blanks, null or digits.

    The given texts hold none of these, so the rule of the test generator puts them in; no row
    is left out.
    """
    by = F.col("doc_id")
    text = (
        F.when(by % 100 == 0, "")
        .when(by % 97 == 0, "   ")
        .when(by % 89 == 0, F.lit(None))
        .when(by % 83 == 0, by.cast("string"))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf_dir).select(
        "doc_id", text.alias("text"), "lang", F.col("source").alias("source_file")
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, labels)`` for the documents that ``labels`` covers."""
    truth = table(spark, sf_dir, "labels")
    names = F.array_compact(
        F.array(
            F.col("lang"),
            F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    return (
        documents(spark, sf_dir)
        .select("doc_id", "text", "lang")
        .join(truth, "doc_id")
        .select("doc_id", "text", names.alias("labels"))
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the labels known for it; many have none."""
    truth = table(spark, sf_dir, "labels")
    names = F.array_compact(
        F.array(
            F.when(F.col("lang") != "en", F.col("lang")),
            F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    return (
        documents(spark, sf_dir)
        .select("doc_id", "lang")
        .join(truth, "doc_id", "left")
        .select("doc_id", names.alias("labels"))
    )


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a label cell written in one of the accepted spellings."""
    lang, source = F.col("lang"), F.col("source")
    cell = (
        F.when(F.col("n_chars") < 30, F.lit(None))
        .when(F.col("n_chars") < 60, F.lit("  \t"))
        .when(F.col("n_chars") < 300, source)
        .when(F.col("n_chars") < 600, F.concat(lang, F.lit(";"), source, F.lit("; ")))
        .when(lang == "en", F.concat(lang, F.lit(" , "), source, F.lit(",, x;y ")))
        .when(lang == "fr", F.concat(lang, F.lit(","), source, F.lit("|b;c| |")))
        .when(
            lang == "de",
            F.concat(F.lit("['"), lang, F.lit("', \""), source, F.lit("\", ' ', None, 1.50, -7,]")),
        )
        .otherwise(F.concat(F.lit("["), lang, F.lit(", "), source, F.lit("]")))
    )
    return documents(spark, sf_dir).select("doc_id", cell.alias("cell"))


def mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with a JSON cell of a type that depends on the kind of event."""
    kind = F.col("event_type")
    cell = (
        F.when(kind == "error", F.lit("null"))
        .when(kind == "view", F.concat(F.lit('"'), kind, F.lit('"')))
        .when(kind == "signup", F.col("user_id").cast("string"))
        .when(kind == "purchase", F.when(F.col("value") > 50, '"NaN"').otherwise('" \\t"'))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", cell.alias("cell"))
