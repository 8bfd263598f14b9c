import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.errors import StrictInputError, TrainingDataError
from marginalia.functions.files import file_stem, file_suffix, output_name, run_stamp
from marginalia.operators import model as nb, quality, summary
from marginalia.operators.external import predict_external, score_external
from marginalia.operators.linear import fit_linear, score_linear
from marginalia.plans import jobs
from marginalia.sinks import models as store
from marginalia.sinks import tables as sinks

from test_files import put
from test_model import labelled, model_weights


@pytest.fixture(scope="module")
def model(spark):
    return nb.fit(labelled(spark)[0])


def test_batch_of_files(spark, folder, model):
    a = put(folder, "in/a.csv", "text,x\nthe w1 a,1\nw2 b,2\nw3 c,3\n")
    b = put(folder, "in/b.csv", "n,text\n" + "".join(f"{i},w{i} a\n" for i in range(4)) + "9,\n")
    empty = put(folder, "in/empty.csv", "text\n")
    out = folder + "/out"
    run = jobs.process_files(spark, [a, b, empty], model, out, "done_", categories=["a", "zzz"], combine=True, kind="csv")
    row = run.summary.first()
    assert (row["total_files"], row["successful_files"], row["failed_files"]) == (3, 2, 1)
    assert (row["total_rows"], row["processed_comments"], row["skipped_comments"]) == (8, 7, 1)
    assert round(row["success_rate"], 2) == 66.67
    files = {r["source_file"]: (r["status"], r["check"], r["skipped"]) for r in run.files.collect()}
    assert files == {"a.csv": ("ok", "ok", 0), "b.csv": ("ok", "ok", 1), "empty.csv": ("failed", "no_data", 0)}
    assert [(r["skipped"], r["skipped_pct"]) for r in run.skips.collect()] == [(1, 20.0)]
    assert run.rows.columns == ["source_file", "file_path", "text", "x", "n", "a", "zzz", "skip_reason"]
    kept = {(r["text"], r["a"] > 0, r["zzz"], r["skip_reason"]) for r in run.rows.collect()}
    assert ("the w1 a", True, 0.0, "none") in kept and (None, False, 0.0, "nan") in kept
    (run_folder,) = [d for d in os.listdir(out) if d.startswith("run_ts=")]
    folders = sorted(d for d in os.listdir(f"{out}/{run_folder}") if d.startswith("output="))
    assert [d[:13] for d in folders] == ["output=done_a", "output=done_b"] and len(folders[0]) == len("output=done_a_20240101_000000")
    combined = spark.read.option("header", True).csv(run.combined_to)
    assert combined.count() == 8 and combined.columns[0] == "source_file"
    assert {r[0] for r in combined.select("source_file").distinct().collect()} == {"a.csv", "b.csv"}


def test_batch_reads_its_parquet_output_back(spark, folder, model):
    a = put(folder, "in/a.csv", "text,x,x,,y.z\nthe w1 a,1,2,3,4\n,2,2,3,4\n")
    run = jobs.process_files(spark, [a], model, folder + "/out")
    assert run.rows.columns == [
        "source_file", "file_path", "text", "x", "x.1", "Unnamed: 3", "y.z", "a", "b", "c", "skip_reason"
    ]
    assert [r["x.1"] for r in run.rows.collect()] == ["2", "2"]
    assert run.rows.count() == 2 and run.combined_to is None
    assert all("/out/run_ts=" in f for f in run.rows.inputFiles())


def test_success_rate_without_files(spark):
    empty = spark.createDataFrame([], "source_file STRING, status STRING, total_rows BIGINT, processed BIGINT, skipped BIGINT")
    assert tuple(summary.batch_summary(empty).first()) == (0, 0, 0, 0.0, 0, 0, 0)
    one_bad = spark.createDataFrame([("a", "ok", 5, 5, 0), ("b", "failed", 0, 0, 0)], empty.schema)
    assert tuple(summary.batch_summary(one_bad).first()) == (2, 1, 1, 50.0, 5, 5, 0)


def test_dry_run(spark, folder):
    rows = "".join(f"text {i}\n" for i in range(90))
    fine = put(folder, "fine.csv", "text,x\n" + rows.replace("\n", ",1\n") + ",1\n" * 10)
    poor = put(folder, "poor.csv", "text,x\n" + rows.replace("\n", ",1\n")[:-2] + "1\n" + ",1\n" * 12)
    long = put(folder, "long.csv", "text\n" + "x" * 5001 + "\n")
    edge = put(folder, "edge.csv", "text\n" + "é" * 5000 + "\n", "latin-1")
    empty = put(folder, "empty.csv", "text\n")
    paths = [fine, poor, long, edge, empty, folder + "/gone.csv", put(folder, "a.txt", "x")]
    got = {r["file"]: r for r in jobs.dry_run(spark, paths).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "fine.csv": "valid", "poor.csv": "warning", "long.csv": "warning", "edge.csv": "valid",
        "empty.csv": "error", "gone.csv": "error", "a.txt": "error",
    }
    assert got["fine.csv"]["empty_rate"] == 0.1 and got["fine.csv"]["size_bytes"] == os.path.getsize(fine)
    assert [i["code"] for i in got["edge.csv"]["issues"]] == ["encoding"]
    assert [(i["code"], i["n"]) for i in got["poor.csv"]["issues"]] == [("empty_rate", 12), ("nan", 12)]
    assert got["edge.csv"]["encoding"] == "latin-1" and got["edge.csv"]["max_text_length"] == 5000
    assert got["empty.csv"]["error"] == "no_data" and got["gone.csv"]["error"] == "not_found"


def test_inference_over_one_table(spark, folder, model):
    df = spark.createDataFrame([(1, "the a"), (2, "w1 b"), (3, "")], "id INT, text STRING")
    run = jobs.run_inference(df, model, "id", categories=["b", "a"], output=folder + "/out")
    row = run.summary.first()
    assert row["total_comments"] == 3 and run.categories.count() == 2
    wide = spark.read.parquet(folder + "/out")
    assert wide.count() == 3 and "predicted" not in wide.columns
    with pytest.raises(StrictInputError):
        jobs.run_inference(df.withColumn("text", F.lit(None).cast("string")), model, "id", strict=True)


def test_inference_keeps_rows_without_a_key(spark, model):
    df = spark.createDataFrame([(1, "the a"), (None, "w1 b"), (None, "w1 b"), (4, None)], "id INT, text STRING")
    run = jobs.run_inference(df, model, "id")
    assert run.rows.count() == run.summary.first()["total_comments"] == 4
    assert run.rows.columns == ["id", "text", "predicted"]


def test_dry_run_writes_no_copy_of_the_rows(spark, folder):
    path = put(folder, "big.csv", "text\n" + "".join(f"some text number {i}\n" for i in range(40_000)))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared) for f in names)
    before = size()
    assert jobs.dry_run(spark, [path]).first()["total_rows"] == 40_000
    assert size() - before < os.path.getsize(path) / 4


def test_a_folder_is_scored_and_counted(spark, folder, model):
    spark.range(100).select(F.concat(F.lit("w1 "), "id").alias("text")).repartition(3).write.parquet(folder + "/in.parquet")
    run = jobs.process_files(spark, [folder + "/in.parquet"], model)
    assert run.rows.count() == 100 and run.summary.first()["total_rows"] == 100
    assert [tuple(r)[:1] + tuple(r)[2:] for r in run.files.collect()] == [("in.parquet", "ok", "ok", 100, 100, 0)]


def test_training_job(spark, folder):
    df, _ = labelled(spark, 200)
    cells = df.withColumn("labels", F.array_join("labels", "|"))
    run = jobs.train(cells, "id", folder, test_size=0.2, valid_size=0.2)
    assert run.sizes == {"train": 120, "validation": 40, "test": 40} and run.version == 1
    assert run.metrics["micro_f1"] > 0.9 and run.model.labels == ("a", "b", "c")
    assert "moderate_dataset" in run.advice
    again = jobs.train(df, "id", folder, base=store.load_model(spark, folder))
    assert again.version == 2 and store.latest_version(spark, folder) == 2
    assert store.model_details(spark, folder, 1)["sizes"]["train"] == 120
    with pytest.raises(TrainingDataError):
        jobs.train(df.filter("id < 30"), "id")


def test_model_versions(spark, folder, model):
    assert store.latest_version(spark, folder) == 0
    assert [store.save_model(model, folder), store.save_model(nb.refine(model, labelled(spark, seed=9)[0]), folder)] == [1, 2]
    first = store.load_model(spark, folder, 1)
    assert first.labels == model.labels and first.bias == model.bias and model_weights(first) == model_weights(model)
    assert store.load_model(spark, folder).bias != first.bias
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, folder, 3)
    texts = spark.createDataFrame([(1, "the a")], "id INT, text STRING")
    assert nb.score(texts, first, "id").collect() == nb.score(texts, model, "id").collect()


def test_combined_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k INT, text STRING")
    b = spark.createDataFrame([("y", 2.0)], "text STRING, v DOUBLE")
    got = sinks.combined([("a", a), ("b", b)])
    assert got.columns == ["source_file", "k", "text", "v"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x", None), ("b", None, "y", 2.0)]


def test_names(spark):
    paths = ["file:/d/a.b.csv", "s3://x/plain", "/d/.hidden", "/d/U.CSV"]
    at = run_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp"))
    p = F.col("p")
    got = spark.createDataFrame([(x,) for x in paths], "p STRING").select(file_stem(p), file_suffix(p), output_name(p, "c_", at)).collect()
    assert [tuple(r)[:2] for r in got] == [("a.b", ".csv"), ("plain", ""), (".hidden", ""), ("U", ".csv")]
    assert got[0][2] == "c_a.b_20240506_070809"


def test_category_summary_and_top(spark):
    df = spark.createDataFrame([(["a", "x"],), (["a", "b"],), ([],), (None,), (["b"],)], "labels ARRAY<STRING>")
    row = summary.run_summary(df).first()
    assert tuple(row) == (5, 5, 2, 5 / 3)
    listed = summary.category_summary(df, ["b", "none", "a"])
    assert [tuple(r) for r in listed.orderBy("idx").collect()] == [(0, "b", 2, 40.0), (1, "none", 0, 0.0), (2, "a", 2, 40.0)]
    assert [tuple(r)[:3] for r in summary.top_categories(listed).orderBy("rank").collect()] == [(1, "b", 2), (2, "a", 2)]
    nothing = summary.category_summary(df.limit(0), ["a"])
    assert tuple(nothing.first()) == (0, "a", 0, 0.0)
    assert tuple(summary.run_summary(df.limit(0)).first()) == (0, 0, 0, 0.0)


def fixed_model():
    def load():
        def predict(texts):
            assert all(t.strip() for t in texts), "skipped texts must not reach the model"
            logits = np.tile([0.9, 0.1, -0.1], (len(texts), 1))
            return 1 / (1 + np.exp(-logits))

        return predict

    return load


def test_an_external_model_gets_texts_piece_by_piece(spark):
    def load():
        def predict(texts):
            assert sum(map(len, texts)) <= max(map(len, texts)) + (1 << 20)
            return np.array([[len(text) / 1e7] for text in texts])

        return predict

    df = spark.range(60, numPartitions=1).select("id", F.repeat(F.lit("x"), (F.when(F.col("id") == 7, 5_000_000).otherwise(100_000 + F.col("id"))).cast("int")).alias("text"))
    got = {r["id"]: r["probs"] for r in score_external(df, load, ["a"]).select("id", "probs").collect()}
    assert got == {i: [5_000_000 / 1e7 if i == 7 else (100_000 + i) / 1e7] for i in range(60)}


def test_external_model(spark):
    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None), (4, "y")], "id INT, text STRING")
    got = {r["id"]: r for r in score_external(df, fixed_model(), ["a", "b", "c", "d"]).collect()}
    assert [round(p, 4) for p in got[1]["probs"]] == [0.7109, 0.525, 0.475, 0.0]
    assert got[2]["probs"] == got[3]["probs"] == [0.0] * 4
    clean = df.filter("id IN (1, 4)")
    assert [r["predicted"] for r in predict_external(clean, fixed_model(), ["a", "b", "c"]).collect()] == [["a", "b"]] * 2
    with pytest.raises(StrictInputError):
        predict_external(df, fixed_model(), ["a"], strict=True)


def test_linear_model(spark):
    df, _ = labelled(spark)
    models = fit_linear(df, ["a", "b", "never"])
    assert set(models) == {"a", "b"}
    texts = spark.createDataFrame([(1, "the a"), (2, "w1 b"), (3, "")], "id INT, text STRING")
    got = {r["id"]: r["probs"] for r in score_linear(texts, models, "id", ["a", "b", "never"]).collect()}
    assert got[1][0] > 0.5 > got[1][1] and got[2][1] > 0.5 > got[2][0]
    assert got[3] == [0.0, 0.0, 0.0] and got[1][2] == 0.0


def test_default_category_list(spark):
    rows = summary.category_table(spark).orderBy("idx").collect()
    assert len(rows) == 13 and (rows[0]["category"], rows[12]["category"]) == ("Колектив", "Інше")


def test_training_looks_at_texts_and_labels_once(spark, monkeypatch):
    seen = []

    def counting(name, function):
        def run(*args, **kwargs):
            seen.append(name)
            return function(*args, **kwargs)

        return run

    for module in (jobs, quality):
        for name in ("text_facts", "label_counts"):
            monkeypatch.setattr(module, name, counting(name, getattr(module, name)))
    jobs.train(labelled(spark)[0], "id")
    assert sorted(seen) == ["label_counts", "text_facts"]
