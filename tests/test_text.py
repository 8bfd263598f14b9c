import pytest
from pyspark.sql import functions as F

from marginalia.errors import MissingColumnError, StrictInputError
from marginalia.functions.text import attention_mask, padded, strip, text_key, tokens
from marginalia.operators import triage


def reasons(df, **kw):
    return [r["skip_reason"] for r in triage.with_skip_reason(df, **kw).orderBy("i").collect()]


def test_reason_of_each_kind_of_string(spark):
    texts = ["Valid comment", "", "   ", "\t\n \r", " ", None, "nan", "NaN", " nan ", "123", "nan\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    expected = ["none", "empty", "whitespace", "whitespace", "whitespace", "empty", "nan", "nan", "none", "none", "none"]
    assert reasons(df) == expected
    expected[5] = "nan"
    assert reasons(df, null_reason="nan") == expected


def test_reason_of_numbers_and_mixed_cells(spark):
    numbers = spark.createDataFrame([(0, 1.5), (1, float("nan")), (2, None)], "i INT, text DOUBLE")
    assert reasons(numbers) == ["non_text", "nan", "empty"]
    whole = spark.createDataFrame([(0, 7), (1, None)], "i INT, text INT")
    assert reasons(whole, null_reason="nan") == ["non_text", "nan"]
    cells = ['"ok"', "123", "true", "null", '""', '"nan"', '{"k": 1}', None]
    mixed = spark.createDataFrame(list(enumerate(cells)), "i INT, c STRING").select(
        "i", F.parse_json("c").alias("text")
    )
    assert reasons(mixed) == ["none", "non_text", "non_text", "empty", "empty", "nan", "non_text", "empty"]


def test_generator_counts(spark):
    i = F.col("id")
    for rows, expected in ((1000, (10, 10, 11, 969)), (5000, (50, 51, 56, 4843))):
        text = (
            F.when(i % 100 == 0, "").when(i % 97 == 0, "  ").when(i % 89 == 0, F.lit(None))
            .when(i % 83 == 0, i.cast("string")).otherwise("some text")
        )
        triaged = triage.with_skip_reason(spark.range(rows).select(text.alias("text")), null_reason="nan")
        counts = {r["skip_reason"]: r["n"] for r in triage.reason_counts(triaged).collect()}
        assert tuple(counts[k] for k in ("empty", "whitespace", "nan", "none")) == expected


def test_strip_agrees_with_python(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    rows = [(p, chr(p) + "a " + chr(p) + "b" + chr(p) * 2) for p in points]
    df = spark.createDataFrame(rows, "p INT, text STRING")
    for p, text, got in df.select("p", "text", strip(F.col("text"))).collect():
        assert got == text.strip(), hex(p)


def test_tokens_pad_and_mask(spark):
    df = spark.createDataFrame([("Їжак, two-3 Four",), ("",)], "t STRING")
    found = tokens(F.col("t"), 3)
    got = df.select(found, padded(found, 4, "_"), attention_mask(found, 4)).collect()
    assert list(got[0]) == [["їжак", "two", "3"], ["їжак", "two", "3", "_"], [1, 1, 1, 0]]
    assert list(got[1]) == [[], ["_"] * 4, [0] * 4]


def test_text_key_tells_texts_apart(spark):
    digest_of_long = spark.sql("SELECT sha2(repeat('x', 70), 256)").first()[0]
    texts = ["", "a", "x" * 63, "x" * 64, "x" * 70, digest_of_long]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    keys = [r[0] for r in df.select(text_key(F.col("t"))).collect()]
    assert len(set(keys)) == len(texts) and max(map(len, keys)) <= 64


def test_strict_check(spark):
    df = spark.createDataFrame([("a" * 11,), (None,)], "text STRING")
    with pytest.raises(StrictInputError, match="null"):
        triage.check_strict(df)
    with pytest.raises(StrictInputError, match="11"):
        triage.check_strict(df.filter("text IS NOT NULL"), max_length=10)
    triage.check_strict(df.limit(0))
    with pytest.raises(MissingColumnError, match="comment"):
        triage.check_strict(df, "comment")


def test_rates_and_shares(spark):
    df = triage.with_skip_reason(
        spark.createDataFrame([("a", "x"), ("a", ""), ("a", " "), ("b", "y")], "source_file STRING, text STRING")
    )
    total = triage.skip_totals(df).first()
    assert (total["total_rows"], total["skipped"], total["empty_rate"]) == (4, 2, 0.5)
    assert triage.skip_totals(df.limit(0)).first()["empty_rate"] == 0.0
    share = {(r[0], r[1]): r[3] for r in triage.reason_share(df, "source_file").collect()}
    assert share[("b", "none")] == 100.0 and round(share[("a", "empty")], 3) == 33.333
    skips = triage.per_file_skips(df).collect()
    assert [(r[0], r[2]) for r in skips] == [("a", 2)]
