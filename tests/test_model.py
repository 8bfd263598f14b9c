import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.errors import TrainingDataError
from marginalia.operators import labels as label_ops, metrics, model as nb, selection
from marginalia.operators.skew import left_join_by_frequency

WORDS = ["the"] + [f"w{i}" for i in range(40)]


def labelled(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        labels = [x for x in ("a", "b", "c") if rng.random() < 0.4]
        words = ["the"] + [rng.choice(WORDS) for _ in range(rng.randint(0, 12))] + labels
        rng.shuffle(words)
        rows.append((i, " ".join(words), labels))
    return spark.createDataFrame(rows, "id INT, text STRING, labels ARRAY<STRING>"), rows


def brute_fit(rows, alpha=1.0, min_df=2):
    docs = [(set(re.findall(r"\w+", text.lower())), set(labels)) for _, text, labels in rows]
    vocabulary = sorted({t for tokens, _ in docs for t in tokens})
    names = sorted({x for _, labels in docs for x in labels})
    weights, bias = {}, {}
    for name in names:
        nl = sum(name in labels for _, labels in docs)
        bias[name] = round(math.log((nl + alpha) / (len(docs) - nl + alpha)) * 1e6)
        for token in vocabulary:
            df = sum(token in tokens for tokens, _ in docs)
            if df < min_df:
                continue
            both = sum(token in tokens and name in labels for tokens, labels in docs)
            p = (both + alpha) / (nl + 2 * alpha)
            q = (df - both + alpha) / (len(docs) - nl + 2 * alpha)
            weights[token, name] = round(math.log(p * (1 - q) / (q * (1 - p))) * 1e6)
            bias[name] += round(math.log((1 - p) / (1 - q)) * 1e6)
    return names, weights, bias


def model_weights(model):
    rows = model.weights.collect()
    return {(r["token"], n): r["w"][i] for r in rows for i, n in enumerate(model.labels)}


def close(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1 for k in a)


@pytest.mark.parametrize("alpha", [1.0, 0.25])
def test_fit_against_brute_force(spark, alpha):
    df, rows = labelled(spark)
    model = nb.fit(df, alpha=alpha)
    names, weights, bias = brute_fit(rows, alpha)
    assert list(model.labels) == names
    assert close(model_weights(model), weights)
    assert all(abs(b - bias[n]) <= len(weights) for n, b in zip(names, model.bias))


def test_fit_does_not_depend_on_partitions(spark):
    df, _ = labelled(spark)
    one, many = nb.fit(df.coalesce(1)), nb.fit(df.repartition(13))
    assert one.bias == many.bias and model_weights(one) == model_weights(many)


def test_score_against_brute_force(spark):
    df, rows = labelled(spark)
    model = nb.fit(df)
    weights = model_weights(model)
    texts = [(0, "the w1 w1 A b"), (1, "unseen words only"), (2, ""), (3, None), (4, "  "), (5, "!!!")]
    got = {r["id"]: r for r in nb.score(spark.createDataFrame(texts, "id INT, text STRING"), model, "id").collect()}
    assert [got[i]["skip_reason"] for i in range(6)] == ["none", "none", "empty", "empty", "whitespace", "none"]
    for i in (0, 1, 5):
        found = set(re.findall(r"\w+", texts[i][1].lower()))
        for j, name in enumerate(model.labels):
            z = model.bias[j] + sum(weights.get((t, name), 0) for t in found)
            assert got[i]["z"][j] == z
            assert math.isclose(got[i]["probs"][j], 1 / (1 + math.exp(-z / 1e6)))
    for i in (2, 3, 4):
        assert got[i]["probs"] == [0.0, 0.0, 0.0]


def test_large_vocabularies_take_the_split_join(spark):
    """Forced past the broadcast limit, with one token in every document, nothing changes."""
    df, _ = labelled(spark)
    model = nb.fit(df)
    texts = df.select("id", F.when(F.col("id") % 9 == 0, "").otherwise(F.col("text")).alias("text"))
    plain = {r["id"]: (r["skip_reason"], r["z"]) for r in nb.score(texts, model, "id").collect()}
    for heavy_rows in (1, 5, 10_000):
        split = nb.score(texts, model, "id", heavy_rows=heavy_rows, broadcast_bytes=0)
        assert {r["id"]: (r["skip_reason"], r["z"]) for r in split.collect()} == plain


def test_rows_without_key_and_one_hot_text(spark):
    df, _ = labelled(spark)
    model = nb.fit(df)
    rows = df.select("text", F.col("id").alias("extra")).unionByName(
        spark.range(300).select(F.lit("the w1 a b").alias("text"), F.lit(-1).alias("extra"))
    ).unionByName(spark.range(50).select(F.lit("").alias("text"), F.lit(-2).alias("extra")))
    keyed = rows.select("*", F.monotonically_increasing_id().alias("id"))
    want = sorted((r["text"], tuple(r["probs"])) for r in keyed.join(nb.score(keyed, model, "id"), "id").collect())
    for limit in (1 << 30, 0):
        got = nb.score_rows(rows, model, heavy_rows=5, broadcast_bytes=limit)
        assert got.columns == ["text", "extra", "skip_reason", "probs"]
        assert sorted((r["text"], tuple(r["probs"])) for r in got.collect()) == want


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_large_vocabularies_shuffle_rare_tokens_only(spark, monkeypatch, limit):
    """Beyond the limit, frequent tokens are held by the tasks: only the others leave their row, and no key of a text is written."""
    monkeypatch.setattr(nb, "AT_ONCE", 7)
    df, _ = labelled(spark)
    model = nb.fit(df)
    written = {}
    monkeypatch.setattr(nb, "materialise", lambda rows, name: written.setdefault(name, rows.localCheckpoint()))
    texts = df.select("id", F.concat("text", F.lit(" unknown"), F.col("id")).alias("text"))
    got = {r["id"]: r["z"] for r in nb.score(texts, model, "id", heavy_rows=3, broadcast_bytes=limit).collect()}
    weights = {r["token"]: (r["df"], r["w"]) for r in model.weights.collect()}
    for r in texts.collect():
        found = [weights[x][1] for x in set(r["text"].lower().split()) if x in weights]
        assert got[r["id"]] == [b + sum(w[i] for w in found) for i, b in enumerate(model.bias)]
    if limit:
        assert not written
    else:
        rest = {x for r in written["held-scores"].collect() for x in r["_found"]["rest"]}
        held = set(weights) - rest
        assert list(written) == ["held-scores"] and 0 < len(held) <= 3
        assert min(weights[x][0] for x in held) > max(weights[x][0] for x in rest & set(weights))


def test_join_by_frequency_is_a_left_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + ["x", "y", "miss", None, None])], "k STRING, i INT")
    keyed = spark.createDataFrame([("hot", 50, 1), ("x", 1, 2), ("y", 1, 3), ("unused", 1, 4)], "k STRING, f INT, v INT")
    want = sorted(map(tuple, rows.join(keyed, "k", "left").select("i", "k", "f", "v").collect()))
    for heavy_rows in (1, 2, 100):
        got = left_join_by_frequency(rows, keyed, "k", "f", 10, 8, heavy_rows, broadcast_bytes=0)
        assert sorted(map(tuple, got.select("i", "k", "f", "v").collect())) == want


def test_refine_equals_fit_on_everything(spark):
    df, _ = labelled(spark)
    old = df.filter("id < 50").withColumn("labels", F.array_remove("labels", "c"))
    new = df.filter("id >= 50")
    refined = nb.refine(nb.fit(old), new)
    whole = nb.fit(old.unionByName(new))
    assert refined.labels == whole.labels == ("a", "b", "c")
    assert refined.bias == whole.bias and model_weights(refined) == model_weights(whole)


def test_empty_and_all_skipped_input(spark):
    df, _ = labelled(spark)
    model = nb.fit(df)
    assert nb.score(df.limit(0), model, "id").count() == 0
    assert nb.score_rows(df.limit(0), model).count() == 0
    blank = df.select("id", F.lit(" ").alias("text"))
    assert {tuple(r["probs"]) for r in nb.score(blank, model, "id").collect()} == {(0.0, 0.0, 0.0)}
    assert {tuple(r["probs"]) for r in nb.score_rows(blank, model).collect()} == {(0.0, 0.0, 0.0)}
    empty = nb.fit(df.limit(0), names=["a"])
    assert empty.labels == ("a",) and nb.score(df, empty, "id").count() == 120


def test_no_labels_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", [])], "id INT, text STRING, labels ARRAY<STRING>")
    with pytest.raises(TrainingDataError):
        nb.fit(df)


def test_null_and_repeated_keys_keep_their_rows(spark):
    model = nb.fit(labelled(spark)[0])
    rows = spark.createDataFrame([(1, "the a"), (1, "w1"), (None, "w1"), (None, None)], "id INT, text STRING")
    for limit in (1 << 30, 0):
        got = nb.score(rows, model, "id", broadcast_bytes=limit).collect()
        assert sorted(r["id"] or 0 for r in got) == [0, 0, 1, 1]
        assert len({tuple(r["z"]) for r in got if r["skip_reason"] == "none"}) == 2


def test_predictions_and_wide_columns(spark):
    df, _ = labelled(spark)
    model = nb.fit(df)
    scored = spark.createDataFrame([(1, [0.5, 0.4999, 0.9], "none")], "id INT, probs ARRAY<DOUBLE>, skip_reason STRING")
    assert nb.with_predictions(scored, model).first()["predicted"] == ["a", "c"]
    assert nb.with_predictions(scored, model, 0.45).first()["predicted"] == ["a", "b", "c"]
    wide = nb.with_category_columns(scored, model, ["c", "zzz", "a"])
    assert wide.columns == ["id", "c", "zzz", "a", "skip_reason"]
    assert tuple(wide.first()) == (1, 0.9, 0.0, 0.5, "none")


def test_scoring_plans(spark, capsys, tmp_path):
    """Narrow while the weights fit; beyond that no exchange carries texts. Tokens are taken once."""
    df, _ = labelled(spark)
    model = nb.fit(df)
    df.write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    nb.score_rows(texts, model).explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("\n\n")[0]
    assert "Exchange" not in tree and "Join" not in tree and tree.count("ArrowEvalPython") == 1
    assert plan.count("regexp_extract_all") == 1 and tree.count("Scan parquet") == 1
    nb.score_rows(texts, model, broadcast_bytes=0).explain("formatted")
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_equal_rows_of_weights_are_held_once(spark, monkeypatch):
    """Rare tokens share few rows of weights: a vocabulary that is over the limit with a row per token is held all the same."""
    monkeypatch.setattr(nb, "LOOKED_UP", 7)
    rows = [(i, f"the alone{i} pair{i // 2} pair{i // 2}", ["a"] if i % 4 < 2 else ["b"]) for i in range(60)]
    rows += [(60, "the new pair3 alone7 new", None), (61, "", None), (62, None, None), (63, "!", None)]
    df = spark.createDataFrame(rows, "id INT, text STRING, labels ARRAY<STRING>")
    model = nb.fit(df.filter("labels IS NOT NULL"))
    together = sum(size for *_, size in nb._sizes_together(model))
    assert len({tuple(r["w"]) for r in model.weights.collect()}) == 5 and together == 91 * 4 + model.token_bytes + 5 * 12
    assert together < model.size() / 1.5
    want = {r["id"]: (r["skip_reason"], r["z"], r["probs"]) for r in nb.score(df, model, "id").collect()}

    def refuse(rows, name):
        raise AssertionError(f"{name} was written")

    monkeypatch.setattr(nb, "materialise", refuse)
    got = {r["id"]: (r["skip_reason"], r["z"], r["probs"]) for r in nb.score(df, model, "id", broadcast_bytes=together).collect()}
    assert got == want
    with pytest.raises(AssertionError, match="held-scores"):
        nb.score(df, model, "id", broadcast_bytes=together - 1)


def test_metrics_example(spark):
    rows = [(["a"], ["a"]), (["a", "b"], ["a"]), (["b"], ["a", "b"])]
    df = spark.createDataFrame(rows, "labels ARRAY<STRING>, predicted ARRAY<STRING>")
    got = metrics.multilabel_metrics(df, ["a", "b", "c"]).first()
    assert got["micro_f1"] == got["micro_precision"] == got["micro_recall"] == 0.75
    assert round(got["macro_f1"], 4) == 0.4889 and round(got["exact_match"], 4) == 0.3333
    cells = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.confusion(df, ["a", "b", "c"]).collect()}
    assert cells == {"a": (2, 1, 0), "b": (1, 0, 1), "c": (0, 0, 0)}


def test_one_pass_selection_agrees_with_trial_by_trial(spark):
    df, _ = labelled(spark)
    training, validation = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    names = ["a", "b", "c"]
    counts = nb.token_counts(training, names=names)
    model, trials = selection.choose_alpha(counts, validation, "id", names, patience=2)
    best, best_score, since, want = None, -1.0, 0, []
    for step, alpha in enumerate(selection.ALPHAS):
        one = nb.fit_from_counts(counts, names, alpha)
        f1 = selection.evaluate(one, validation, "id").first()["micro_f1"]
        want.append((step, alpha, f1, f1 > best_score))
        if f1 > best_score:
            best, best_score, since = alpha, f1, 0
        else:
            since += 1
            if since == 2:
                break
    assert [(x.step, x.alpha, x.micro_f1, x.improved) for x in trials] == want
    assert model.alpha == best


def test_confusion_does_not_grow_with_the_vocabulary(spark):
    """A row gives cells for its own labels alone; the totals stand in a row without label."""
    rows = [(["a"], ["a"]), (["a", "b", "a", "zz"], ["a"]), (["b"], ["a", "b"]), (None, None), ([], ["zz"])]
    df = spark.createDataFrame(rows, "labels ARRAY<STRING>, predicted ARRAY<STRING>")
    names = ["a", "b", *[f"c{i}" for i in range(3000)]]
    found = {r["label"]: r for r in metrics.cells(df, names).collect()}
    assert len(found) == 3003 and (found[None]["rows"], found[None]["exact"]) == (5, 3)
    assert sum(r["tp"] + r["fp"] + r["fn"] for r in found.values() if r["label"]) == 5
    small, large = (metrics.cells(df, names[:k])._jdf.queryExecution().analyzed().treeString().count("\n") for k in (3, 3000))
    assert small == large


def test_five_thousand_labels(spark):
    """Counts, weights and biases of many labels, as pairs, equal those of few labels side by side."""
    draw = random.Random(5)
    names = [f"l{i:04d}" for i in range(5000)]
    rows = [(i, " ".join(f"t{draw.randint(0, 60)}" for _ in range(4)), [names[i % 5000], draw.choice(names)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id INT, text STRING, labels ARRAY<STRING>")
    model = nb.fit(df)
    assert model.labels == tuple(names)
    few = nb.fit(df, names=names[7:10])
    many = {r["token"]: r["w"] for r in model.weights.collect()}
    assert {r["token"]: r["w"] for r in few.weights.collect()} == {k: w[7:10] for k, w in many.items()}
    assert few.bias == model.bias[7:10]
    scored = nb.with_predictions(nb.score_rows(df, model), model)
    assert metrics.multilabel_metrics(scored, names).first()["micro_precision"] >= 0
    table = label_ops.vocabulary_table(df).collect()
    assert sorted((r["idx"], r["label"]) for r in table) == list(enumerate(names))


@pytest.mark.parametrize("flagged", [0, 32])
def test_pairs_and_columns_count_alike(spark, monkeypatch, flagged):
    df, rows = labelled(spark)
    df = df.unionByName(spark.createDataFrame([(900, "w1 w1 w2", ["a", "a", "other"]), (901, None, ["b"]), (902, "w1", None)], df.schema))
    monkeypatch.setattr(nb, "FLAGGED", flagged)
    counts = {(r["token"], r["label"]): r["n"] for r in nb.token_counts(df, names=["a", "b", "c"]).collect()}
    expected = {}
    for r in df.collect():
        for token in {None, *re.findall(r"\w+", (r["text"] or "").lower())}:
            for label in [None, *({"a", "b", "c"} & set(r["labels"] or []))]:
                expected[token, label] = expected.get((token, label), 0) + 1
    assert counts == expected
