import pytest

from marginalia.errors import MissingColumnError, TrainingDataError
from marginalia.operators import quality


def table(spark, n, text=lambda i: f"text number {i}", labels=lambda i: ["a", "b"]):
    return spark.createDataFrame([(text(i), labels(i)) for i in range(n)], "text STRING, labels ARRAY<STRING>")


def verdict(rules):
    row = quality.first_failure(rules).first()
    return row["is_valid"], row["failed_rule"]


def warnings(df):
    return {r["rule"] for r in quality.training_gate(df).collect() if r["severity"] == "warning" and not r["passed"]}


def test_gate_first_failure_wins(spark):
    assert verdict(quality.training_gate(table(spark, 50))) == (True, None)
    assert verdict(quality.training_gate(table(spark, 49))) == (False, "enough_rows")
    blank = table(spark, 50, lambda i: "  " if i == 3 else f"text number {i}", lambda i: [])
    assert verdict(quality.training_gate(blank)) == (False, "no_blank_text")
    assert verdict(quality.training_gate(table(spark, 50, labels=lambda i: []))) == (False, "has_labels")
    rare = table(spark, 50, labels=lambda i: ["a", "r"] if i < 4 else ["a"])
    assert verdict(quality.training_gate(rare)) == (False, "enough_per_label")


def test_gate_limits_are_inclusive(spark):
    even = table(spark, 100, labels=lambda i: ["a", "b"] if i < 5 else ["a"])
    assert warnings(even) == set()
    steep = table(spark, 105, labels=lambda i: ["a", "b"] if i < 5 else ["a"])
    assert warnings(steep) == {"imbalance"}
    assert warnings(table(spark, 100, lambda i: f"text number {max(i, 10)}")) == set()
    assert warnings(table(spark, 100, lambda i: f"text number {max(i, 11)}")) == {"duplicates"}
    assert warnings(table(spark, 100, lambda i: f"t{i}" if i < 20 else f"text number {i}")) == set()
    assert warnings(table(spark, 100, lambda i: f"t{i}" if i < 21 else f"text number {i}")) == {"short_texts"}


def test_gate_accepts_strings_and_category_columns(spark):
    rows = [(f"text number {i}", "a , b,", "x") for i in range(50)]
    df = spark.createDataFrame(rows, "text STRING, labels STRING, `Category 1` STRING")
    assert verdict(quality.training_gate(df)) == (True, None)
    assert verdict(quality.training_gate(df.drop("labels"))) == (True, None)
    with pytest.raises(MissingColumnError):
        quality.training_gate(df.select("text"))


def test_light_gate(spark):
    assert verdict(quality.light_gate(table(spark, 10))) == (True, None)
    assert verdict(quality.light_gate(table(spark, 9))) == (False, "enough_rows")
    assert verdict(quality.light_gate(table(spark, 9).limit(0))) == (False, "not_empty")
    assert verdict(quality.light_gate(table(spark, 12, lambda i: None if i == 2 else "t"))) == (False, "no_null_text")
    assert verdict(quality.light_gate(table(spark, 12, labels=lambda i: None if i == 2 else []))) == (False, "no_null_labels")
    with pytest.raises(MissingColumnError):
        quality.light_gate(table(spark, 10).drop("labels"))


def test_enforce(spark):
    with pytest.raises(TrainingDataError, match="enough_rows"):
        quality.enforce(quality.training_gate(table(spark, 20)))
    assert quality.enforce(quality.training_gate(table(spark, 60, lambda i: "same text here"))) == ["duplicates"]


def test_recommendations(spark):
    def advice(df):
        return [(r["advice"], r["n"]) for r in quality.recommendations(df).orderBy("position").collect()]

    assert advice(table(spark, 99)) == [("small_dataset", 99)]
    assert advice(table(spark, 100)) == [("moderate_dataset", 100)]
    assert advice(table(spark, 500)) == []
    odd = table(spark, 500, lambda i: {0: "t", 1: "t", 2: "x" * 1001}.get(i, f"text number {i}"))
    assert advice(odd) == [("remove_duplicates", 1), ("review_short_texts", 2), ("review_long_texts", 1)]


def test_null_is_one_value_for_duplicates(spark):
    facts = quality.text_facts(spark.createDataFrame([(None,), (None,), ("a",)], "text STRING")).first()
    assert (facts["total_rows"], facts["duplicates"], facts["null_texts"]) == (3, 1, 2)
