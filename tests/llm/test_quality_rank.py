"""Quality ranking against plain features and a plain optimum, and its held-out accuracy."""

import math
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose

from marginalia.llm import quality_rank as q, queries

BLANKS = b" \t\n\x0b\x0c\r"


def kind(b):
    if chr(b) in ".,;:?'\"()-":
        return 5
    if b in (10, 11, 12, 13):
        return 4
    if b <= 32:
        return 3
    return 7 if b > 127 else 2 if 48 <= b <= 57 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 6


def words(data):
    out, word = [], bytearray()
    for b in data + b" ":
        if b in BLANKS:
            out, word = [*out, bytes(word).lower()] if word else out, bytearray()
        else:
            word.append(b)
    return out


def plain(data):
    pairs = [0] * 64
    for a, b in zip(data, data[1:], strict=False):
        pairs[kind(a) * 8 + kind(b)] += 1
    w = words(data)
    size, n = len(data), max(len(w), 1)
    same = [sum(a == b for a, b in zip(w[k:], w, strict=False)) for k in (1, 2)]
    return [math.sqrt(p / max(size, 1)) for p in pairs] + [
        math.log1p(size), sum(map(len, w)) / n, same[0] / n, same[1] / n,
        math.log1p(len(w) / (data.count(b"\n") + 1)), math.log1p(len(w)) / max(math.log1p(size), 1),
    ]


def test_features_of_whole_texts():
    texts = ["", None, "a", "Go GO go stop go!", "Éa\r\n\t x-1 | y", " \n ", "A" * 50, prose(1, 40) + "\n" + prose(2, 3), "z z z z\x00\x7f"]
    got = q.text_features(pa.array(texts))
    assert np.allclose(got, [plain((x or "").encode()) for x in texts])


def test_long_texts_are_counted_in_blocks():
    text = prose(3, 4000)
    whole, parts = (q.text_features(pa.array(["x", text, "b c"]), block) for block in (1 << 20, 5000))
    assert np.allclose(whole[[0, 2]], parts[[0, 2]])
    assert np.abs(whole[1] - parts[1]).max() < 0.02
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    bounds = q.cuts(data, 0, len(data), 5000)
    assert max(np.diff(bounds)) <= 5000 and all(chr(data[b]) == " " for b in bounds[1:-1])
    assert np.diff(q.cuts(np.full(20_000, 97, dtype=np.uint8), 0, 20_000, 5000)).tolist() == [5000] * 4


def test_a_text_of_many_megabytes():
    """Its memory is that of blocks: about as fast and as small as many short ones."""
    text = "word next line\n" * (40 << 20 >> 4)
    import tracemalloc

    column = pa.array([text])
    tracemalloc.start()
    found = q.text_features(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and found[0, q.PAIRED + 2] == 0


def test_weights_are_the_optimum_of_the_pairs():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(40, 3))
    good = (x[:, 0] + 0.5 * draw.normal(size=40) > 0).astype(int)
    model = q.train(x, good, 0.5, pairs=50)
    z = np.clip((x - model.mean) / model.spread, -q.FAR, q.FAR)
    wins = {(i, j) for i, j in product(range(40), repeat=2) if good[i] and not good[j]}

    def loss(w):
        return np.mean([math.log1p(math.exp(-(z[i] - z[j]) @ w)) for i, j in wins]) + q.RIDGE / 2 * w @ w

    best = loss(model.weights)
    step = 0.5 * np.abs(model.weights).max()
    assert all(best < loss(model.weights + step * d) for d in [*np.eye(3), *-np.eye(3)])


def test_threshold_is_a_quantile():
    values, ones = np.array([5.0, 1, 2, 3, 4]), np.ones(5)
    assert [q.quantile(values, ones, s) for s in (0.2, 0.4, 0.8, 1.0)] == [1.5, 2.5, 4.5, 5.0]
    assert q.quantile(values, np.array([1, 6, 1, 1, 1.0]), 0.5) == 1.5
    assert q.quantile(np.array([1.0, 1, 1, 2]), np.ones(4), 0.5) == 1.5


def test_held_out_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_quality"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i], y) for i, y in labels if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == y for r, y in held]) > 0.95


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 1), (14, 0), (15, 0), (14, None), (None, 1), (13, 1), (13, 0), (8, 5)], "doc_id long, quality int")
    model = q.fit(odd_documents, labels)
    rows = [(r["doc"], r["score"]) for r in q.quality(odd_documents, model).collect()]
    assert len(rows) == odd_documents.count() and all(0 <= s <= 1 for _, s in rows)
    scores = dict(rows)
    assert scores[5] == scores[6] and scores[1] == scores[2] and scores[1] >= q.CUT > scores[14]
    again = q.fit(odd_documents.repartition(7), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))
    assert q.fit(odd_documents, labels.filter("quality = 1")) is None
    assert {r["score"] for r in q.quality(odd_documents, None).collect()} == {q.CUT}
    assert q.fit(no_documents, labels) is None and q.quality(no_documents, model).count() == 0


def _many(spark, n, other):
    """Documents of both labels in turns; those in ``other`` are written in capitals."""
    rows = [(i, (prose(i, 3 + i % 9) + " 12 x-y" * (i % 2)).upper() if i in other else prose(i, 3 + i % 9) + " 12 x-y" * (i % 2), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_every_labelled_document_is_learnt_from(spark):
    """Also those beyond the first 3000 of a label by the hash of their ids, and the threshold holds over all of them."""
    n = 7000
    table = spark.range(n).select(F.xxhash64("id").alias("h"), "id")
    first = {r["id"] for k in (0, 1) for r in table.filter(F.col("id") % 2 == k).orderBy("h").limit(3000).collect()}
    documents = _many(spark, n, set(range(n)) - first)
    model = q.fit(documents, documents)
    x = q.text_features(pa.array([r["text"] for r in documents.select("text").collect()]))
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-3), atol=1e-6)
    raw = model.raw(x)
    assert model.threshold == pytest.approx(q.quantile(raw, np.ones(n), 0.5), abs=1e-9)
    assert (raw < model.threshold).sum() == n // 2


def test_groups_hold_both_labels_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(q, "GROUP", 20)
    monkeypatch.setattr(q, "LEAST", 16)
    rows = spark.range(600).select("id", (F.col("id") < 30).cast("int").alias("label"), F.array_repeat(F.col("id").cast("double"), 2).alias("features"))
    found = q.grouped(rows, {0: 570, 1: 30}).collect()
    assert len(found) == 29 and all({r["label"] for r in g["rows"]} == {0, 1} for g in found)
    assert sorted(r["features"][0] for g in found for r in g["rows"] if r["own"]) == list(range(600))


def test_threshold_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW", 5)
    monkeypatch.setattr(q, "BINS", 4)
    draw = np.random.default_rng(3)
    for values in (draw.normal(size=300), np.round(draw.normal(size=300), 1), np.ones(50), np.r_[np.ones(90), 2.0], np.r_[-1e9, draw.normal(size=40)]):
        label = draw.integers(0, 2, len(values))
        weights = {0: 0.3, 1: 2.0}
        scores = spark.createDataFrame(list(zip(label.tolist(), values.tolist(), strict=True)), "label int, raw double")
        for share in (0.01, 0.37, 0.999, 1.0):
            assert q.quantile_of(scores, weights, share) == q.quantile(values, np.where(label == 1, 2.0, 0.3), share)
