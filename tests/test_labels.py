import ast
import random

import pytest
from pyspark.sql import functions as F

from marginalia.errors import MissingColumnError, VocabularyError
from marginalia.functions.labels import parse_label_cell
from marginalia.operators import labels as ops

CELLS = {
    None: [],
    "": [],
    " \t": [],
    "a, b ,,c": ["a", "b", "c"],
    "a,b|c;d": ["a,b", "c;d"],
    "a;b": ["a", "b"],
    "['a', 'b']": ["a", "b"],
    '["a","b"]': ["a", "b"],
    "[a, b]": ["[a", "b]"],
    "single": ["single"],
    "[]": [],
    "['a', None, True, 7, 2.50, ]": ["a", "None", "True", "7", "2.5"],
    '["it\'s", \'say "x"\', \'q\\\'q\']': ["it's", 'say "x"', "q'q"],
    "['a', null]": ["['a'", "null]"],
    "['a|b', ' ']": ["a|b"],
    "|": [],
}


def test_label_cells(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c STRING")
    got = {r[0]: r[1] for r in df.select("c", parse_label_cell(F.col("c"))).collect()}
    assert got == CELLS


def test_written_lists_read_like_literals(spark):
    rng = random.Random(5)
    pool = ["a", "b c", "it's", 'x"y', "Їжак", " pad ", "", "a|b", "1,2", 3, -4, 2.5, None, True]
    lists = [[rng.choice(pool) for _ in range(rng.randint(0, 5))] for _ in range(200)]
    df = spark.createDataFrame([(repr(x),) for x in lists], "c STRING")
    for text, got in df.select("c", parse_label_cell(F.col("c"))).collect():
        assert got == [str(x).strip() for x in ast.literal_eval(text) if str(x).strip()]


def test_cells_of_other_types(spark):
    df = spark.createDataFrame([(["a ", " ", None],), (None,)], "c ARRAY<STRING>")
    assert [r[0] for r in df.select(parse_label_cell(F.col("c"), df.schema["c"].dataType)).collect()] == [["a"], []]
    for kind, values, expected in (
        ("INT", [3, None], [["3"], []]),
        ("DOUBLE", [2.0, float("nan"), None], [["2.0"], [], []]),
    ):
        df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
        got = df.select(parse_label_cell(F.col("c"), df.schema["c"].dataType)).collect()
        assert [r[0] for r in got] == expected


def test_numbered_columns_win_and_sort_by_number(spark):
    df = spark.createDataFrame(
        [("t", "z", " ", "x", "no"), (None, None, "y", None, "no")],
        "text STRING, `Category 10` STRING, `Category 2` STRING, `Category 1` STRING, labels STRING",
    )
    got = ops.labelled_table(df).collect()
    assert [(r["text"], r["labels"]) for r in got] == [("t", ["x", "z"]), ("", ["y"])]
    assert ops.numbered_category_columns(["Category x", "Category a 2", "Category 1", "category 3"]) == [
        "Category 1", "Category a 2"
    ]


@pytest.mark.parametrize("pattern", ["label_*", "label_1"])
def test_pattern_columns_keep_table_order(spark, pattern):
    df = spark.createDataFrame([("t", "b", " a", None)], "text STRING, label_2 STRING, label_1 STRING, label_3 STRING")
    assert ops.labelled_table(df, labels_col=pattern).first()["labels"] == ["b", "a"]
    with pytest.raises(MissingColumnError):
        ops.labelled_table(df, labels_col="category_*")


def test_single_column_and_missing_columns(spark):
    df = spark.createDataFrame([("t", "a,b")], "comment STRING, tags STRING")
    assert ops.labelled_table(df, "comment", "tags").first()["labels"] == ["a", "b"]
    with pytest.raises(MissingColumnError):
        ops.labelled_table(df, "comment", "labels")
    with pytest.raises(MissingColumnError):
        ops.labelled_table(df, "text", "tags")


def test_vocabulary_and_multi_hot_round_trip(spark):
    rows = [(["c", "a", "c", "zzz"],), ([],), (None,), (["b"],)]
    df = spark.createDataFrame(rows, "labels ARRAY<STRING>")
    assert ops.vocabulary(df) == ["a", "b", "c", "zzz"]
    got = [r["labels_multi"] for r in ops.with_multi_hot(df, ["a", "b", "c"]).collect()]
    assert got == [[1, 0, 1], [0, 0, 0], [0, 0, 0], [0, 1, 0]]
    with pytest.raises(VocabularyError):
        ops.vocabulary(df, limit=3)
    table = ops.vocabulary_table(df).orderBy("idx").collect()
    assert [(r["idx"], r["label"]) for r in table] == [(0, "a"), (1, "b"), (2, "c"), (3, "zzz")]


def test_counts_rare_and_imbalance(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["a"],), ([],)], "labels ARRAY<STRING>")
    counts = ops.label_counts(df)
    assert [tuple(r) for r in ops.ranked_counts(counts).collect()] == [("a", 3), ("b", 1)]
    assert [r["label"] for r in ops.rare_labels(counts, 2).collect()] == ["b"]
    assert tuple(ops.imbalance(counts).first()) == (2, 3, 1, 3.0)
    assert tuple(ops.imbalance(counts.limit(0)).first()) == (0, 0, 0, 0.0)


def test_wide_labels(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id INT, labels ARRAY<STRING>")
    wide = ops.labels_to_wide(df)
    assert wide.columns == ["id", "Category 1", "Category 2"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(1, "x", "y"), (2, "", ""), (3, "", "")]
    assert ops.labels_to_wide(df.limit(0)).columns == ["id"]
