import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyzäéñ"


def prose(seed: int, n: int) -> str:
    """Invented words, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null, empty, blank, short, long, repeated and copied texts; other columns with clashing names."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "  ", 3)), (4, " ".join(base.split()[:110] + ["zz"] * 3)),
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "Two words"), (10, "日本語 テキスト"), (11, "1234 !!"),
        (12, prose(2, 30_000)), (13, prose(3, 300) + " " + base), (13, prose(3, 300) + " " + base),
        (14, "aaaa " * 200), (15, "b" * 1500), (None, base), (None, None), (16, prose(4, 60) + "\x00\x01" + prose(5, 60)),
    ]
    names = "doc_id long, text string, doc string, row string, version string, n int, score string, h int, `range` int, words string, lang string, key int"
    data = [(i, x, "x", "y", "z", 7, "s", 1, 2, "w", "en", 9) for i, x in rows]
    return spark.createDataFrame(data, names).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
