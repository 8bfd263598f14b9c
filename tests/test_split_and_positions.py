import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.errors import KeyNotUniqueError
from marginalia.operators import position, split


def expected_split(keys, test, valid, seed=42):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    a, b = int(len(keys) * test), int(len(keys) * valid)
    return {k: "test" if i < a else "validation" if i < a + b else "train" for i, k in enumerate(order)}


@pytest.mark.parametrize("n,test,valid", [(1000, 0.1, 0.1), (15, 0.1, 0.1), (399, 0.15, 0.2), (7, 0.0, 0.5), (5, 0.1, 0.1), (1, 0.5, 0.5)])
def test_split_is_exact(spark, n, test, valid):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["k"]: r["split"] for r in split.with_split(df, "k", test, valid).collect()}
    assert got == expected_split(range(n), test, valid)


def test_split_descends_into_prefixes(spark, monkeypatch):
    monkeypatch.setattr(split, "DIRECT_PICK", 1)
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(7)
    got = {r["k"]: r["split"] for r in split.with_split(df, "k", 0.2, 0.1, seed=7).collect()}
    assert got == expected_split(range(3000), 0.2, 0.1, 7)


def test_split_works_on_string_keys_and_refuses_repeats(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(60)], "k STRING, v INT")
    got = {r["k"]: r["split"] for r in split.with_split(df, "k", 0.3, 0.3).collect()}
    assert got == expected_split([f"k{i}" for i in range(60)], 0.3, 0.3)
    with pytest.raises(KeyNotUniqueError):
        split.with_split(spark.createDataFrame([(1,)] * 20, "k INT"), "k", 0.3, 0.3)


def test_assigning_the_split_needs_no_shuffle(spark, capsys):
    split.with_split(spark.range(1000).withColumnRenamed("id", "k"), "k").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan


def test_shuffled_order(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = [r["k"] for r in split.shuffled(df, "k").collect()]
    order = sorted(range(50), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert got == order


def test_positions_with_one_hot_group(spark):
    df = spark.range(5000).select(
        (F.col("id") * 3 + 1).alias("k"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.col("id") % 50)).when(F.col("id") % 7 > 0, "hot").alias("g")
    )
    rows = [tuple(r) for r in df.collect()]
    want, seen = {}, {}
    for k, g in sorted(rows):
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + 1
    got = position.with_chunks(df.repartition(5), "k", "g", 100, buckets=16).collect()
    assert {r["k"]: r["row_pos"] for r in got} == want
    assert all(r["chunk"] == r["row_pos"] // 100 for r in got)


def test_chunk_table(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)] * 10, "f STRING")
    got = sorted(tuple(r) for r in position.chunk_table(df, "f", 10).collect())
    assert got == [("a", 0, 0, 10), ("a", 1, 10, 10), ("a", 2, 20, 5), ("b", 0, 0, 10)]
    assert position.with_positions(spark.createDataFrame([], "k BIGINT, f STRING"), "k", "f").count() == 0


def test_null_and_repeated_keys_are_refused(spark):
    repeated = spark.range(1000).select((F.col("id") % 50).alias("k"), F.lit("f").alias("f"))
    null = spark.createDataFrame([(1, "f"), (None, "f")], "k INT, f STRING")
    for df in (repeated, null):
        with pytest.raises(KeyNotUniqueError):
            split.with_split(df, "k")
        with pytest.raises(KeyNotUniqueError):
            position.with_positions(df, "k", "f")


def test_positions_of_text_and_date_keys(spark):
    rows = [(f"k{i * 7919 % 1000:04d}", f"g{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, g STRING")
    got = {r["k"]: r["row_pos"] for r in position.with_positions(df, "k", "g", buckets=8).collect()}
    want, seen = {}, {}
    for k, g in sorted(rows):
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + 1
    assert got == want
    dated = spark.range(30).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("k"), F.lit("x").alias("g"))
    assert [r["row_pos"] for r in position.with_positions(dated, "k", "g", buckets=4).orderBy("k").collect()] == list(range(30))


def test_chunk_table_of_many_chunks(spark):
    df = spark.range(25_050).select(F.lit("a").alias("f"))
    got = position.chunk_table(df, "f", 1).agg(F.count("*"), F.max("chunk"), F.sum("n_rows"), F.countDistinct("chunk")).first()
    assert tuple(got) == (25_050, 25_049, 25_050, 25_050)
