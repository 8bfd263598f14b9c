import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import model as nb, triage
from marginalia.streaming import arrivals, classify

from test_files import put
from test_model import labelled


def arriving(spark, folder):
    text = F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("the w1 a "), F.col("id")))
    df = spark.range(200).select("id", text.alias("text"))
    df.repartition(4).write.parquet(folder + "/in")
    return spark.read.parquet(folder + "/in"), classify.read_arriving(spark, folder + "/in", "id BIGINT, text STRING", files_per_trigger=1)


def test_running_counts_equal_the_batch_counts_and_continue(spark, folder):
    batch, stream = arriving(spark, folder)
    log = classify.ProgressLog(spark)
    query = classify.running_counts(stream, folder + "/out", folder + "/cp")
    query.awaitTermination()
    progress = log.rows(query)
    log.close()
    assert sum(rows for _, rows in progress) == 200 and len(progress) >= 4
    want = {tuple(r) for r in triage.reason_counts(triage.with_skip_reason(batch)).collect()}
    assert {tuple(r) for r in classify.latest_counts(spark, folder + "/out").collect()} == want
    spark.range(3).select(F.col("id") + 1000, F.lit("").alias("text")).toDF("id", "text").coalesce(1).write.mode("append").parquet(folder + "/in")
    classify.running_counts(stream, folder + "/out", folder + "/cp").awaitTermination()
    after = {r["skip_reason"]: r["n"] for r in classify.latest_counts(spark, folder + "/out").collect()}
    before = dict(want)
    assert after["empty"] == before["empty"] + 3 and after["none"] == before["none"]


def test_category_counts(spark, folder):
    labelled(spark)[0].repartition(3).write.parquet(folder + "/in")
    stream = classify.read_arriving(spark, folder + "/in", "id INT, text STRING, labels ARRAY<STRING>", files_per_trigger=1)
    classify.running_category_counts(stream, folder + "/out", folder + "/cp").awaitTermination()
    want = {tuple(r) for r in spark.read.parquet(folder + "/in").select(F.explode("labels").alias("c")).groupBy("c").count().collect()}
    assert {tuple(r) for r in classify.latest_counts(spark, folder + "/out").collect()} == want


def test_classified_stream_equals_batch(spark, folder):
    batch, stream = arriving(spark, folder)
    model = nb.fit(labelled(spark)[0])
    classify.classify_arriving(stream, model, "id", folder + "/out", folder + "/cp").awaitTermination()
    got = spark.read.parquet(folder + "/out/batch=*")
    want = nb.with_predictions(nb.score(batch, model, "id"), model)
    columns = ["id", "skip_reason", "probs", "predicted"]
    assert got.select(columns).orderBy("id").collect() == want.select(columns).orderBy("id").collect()


def test_an_arriving_table_is_a_file_or_a_folder(spark, folder):
    model = nb.fit(labelled(spark)[0])
    rows = spark.range(40).select("id", F.lit("the w1 a").alias("text"))
    rows.repartition(3).write.parquet(folder + "/many/t.parquet")
    rows.coalesce(1).write.parquet(folder + "/parts")
    (part,) = [name for name in os.listdir(folder + "/parts") if name.endswith(".parquet")]
    os.makedirs(folder + "/one")
    os.link(f"{folder}/parts/{part}", folder + "/one/t.parquet")
    for name in ("many", "one"):
        rows.limit(5).write.parquet(f"{folder}/{name}/other.parquet")
        stream = classify.read_arriving(spark, f"{folder}/{name}", "id BIGINT, text STRING", pattern="t.parquet")
        classify.classify_arriving(stream, model, "id", f"{folder}/{name}-out", f"{folder}/{name}-cp").awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/{name}-out/batch=*").collect()) == list(range(40))


def test_observed_rows(spark):
    seen = []
    df, rows = classify.observed(spark.range(25), "scan", seen.append)
    df.write.format("noop").mode("overwrite").save()
    assert rows() == 25 and seen == [25]


def test_progress_over_more_batches_than_spark_keeps(spark, folder):
    spark.range(60).select("id", F.lit("x").alias("text")).repartition(6).write.parquet(folder + "/in")
    stream = classify.read_arriving(spark, folder + "/in", "id BIGINT, text STRING", files_per_trigger=1)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    log = classify.ProgressLog(spark)
    try:
        query = classify.running_counts(stream, folder + "/out", folder + "/cp")
        query.awaitTermination()
        assert sum(rows for _, rows in log.rows(query)) == 60 and len(query.recentProgress) <= 2
    finally:
        log.close()
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def test_arriving_csv_files_are_bound_by_header(spark, folder):
    put(folder, "in/a.csv", "text,id\nthe a,1\n")
    put(folder, "in/b.csv", "id,x,text\n2,9,w1 b\n3,9,\n")
    model = nb.fit(labelled(spark)[0])
    classify.classify_arriving_csv(spark, folder + "/in", model, folder + "/out", folder + "/cp").awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(folder + "/out/batch=*").collect()}
    assert {i: r["text"] for i, r in rows.items()} == {"1": "the a", "2": "w1 b", "3": None}
    assert rows["2"]["x"] == "9" and rows["3"]["skip_reason"] == "empty"
    with pytest.raises(ValueError):
        classify.read_arriving(spark, folder + "/in", "text STRING", kind="csv")


def _arrive(spark, folder, model, **options):
    query = classify.classify_arriving_csv(spark, folder + "/in", model, folder + "/out", folder + "/cp", ledger=folder + "/book", **options)
    query.awaitTermination()


def test_a_bad_file_does_not_stop_the_stream(spark, folder):
    put(folder, "in/a.csv", "text,id\nthe a,1\n")
    put(folder, "in/lacks.csv", "txet,id\nx,8\n")
    put(folder, "in/broken.csv", "text,id\nw1 b,5\n")
    put(folder, "in/.broken.csv.crc", "crc\0" + "\0" * 12)
    put(folder, "in/nothing.csv", "")
    put(folder, "in/names.csv", "text,id\n")
    model = nb.fit(labelled(spark)[0])
    _arrive(spark, folder, model, files_per_trigger=2)
    status = {r["source_file"]: r["status"] for r in arrivals.file_status(spark, folder + "/book").collect()}
    want = {"a.csv": "ok", "lacks.csv": "missing_column", "broken.csv": "unreadable", "names.csv": "no_data"}
    assert status == want
    put(folder, "in/long.csv", "id,text\n2,w1 b,more\n3,the a\n4,\"x\ny\"\n")
    _arrive(spark, folder, model)
    rows = {r["id"]: r["text"] for r in arrivals.published_rows(spark, folder + "/out", folder + "/book").collect()}
    assert rows == {"1": "the a", "3": "the a", "4": "x\ny"}
    assert [r["record"] for r in arrivals.dead_records(spark, folder + "/book").collect()] == ["2,w1 b,more"]
    assert tuple(arrivals.progress(spark, folder + "/book").first()) == (5, 3, 2, 3, 1)
    # The broken file is mended, the other one stays bad; nothing else is taken twice.
    os.unlink(folder + "/in/.broken.csv.crc")
    scored = lambda rows: nb.with_predictions(nb.score_rows(rows, model, "text", "empty"), model)
    assert arrivals.retry_files(spark, "text", scored, folder + "/out", folder + "/book", files_per_batch=1) == 1
    assert tuple(arrivals.progress(spark, folder + "/book").first()) == (5, 4, 1, 4, 1)
    tries = {r["source_file"]: r["attempts"] for r in arrivals.file_status(spark, folder + "/book").collect()}
    assert tries["broken.csv"] == 2 == tries["lacks.csv"] and tries["a.csv"] == 1
    assert arrivals.published_rows(spark, folder + "/out", folder + "/book").count() == 4


@pytest.mark.parametrize("dies", ["records", "output", "files"])
def test_a_batch_that_died_is_taken_whole_and_once(spark, folder, dies, monkeypatch):
    path = put(folder, "in/a.csv", "text,id\nthe a,1\nb,2,3\n")
    place = dict(text_col="text", output=folder + "/out", ledger=folder + "/book")

    def fails(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if dies == "records":
            patch.setattr(arrivals, "read_csv", fails)
        if dies == "files":
            patch.setattr(arrivals, "_write_files", fails)
        with pytest.raises(KeyboardInterrupt):
            arrivals.take_csv(spark, [path], 0, transform=fails if dies == "output" else lambda rows: rows, **place)
    assert arrivals.recorded_files(spark, folder + "/book").count() == 0
    assert arrivals.dead_records(spark, folder + "/book").count() == 0
    for _ in range(2):
        arrivals.take_csv(spark, [path], 0, transform=lambda rows: rows, **place)
        assert tuple(arrivals.progress(spark, folder + "/book").first()) == (1, 1, 0, 1, 1)
    assert [r["id"] for r in arrivals.published_rows(spark, folder + "/out", folder + "/book").collect()] == ["1"]


def test_published_batches_alone_are_read(spark, folder):
    path = put(folder, "in/a.csv", "text\nthe a\n")
    place = dict(text_col="text", transform=lambda rows: rows, output=folder + "/out", ledger=folder + "/book")
    arrivals.take_csv(spark, [path], 3, **place)
    spark.range(5).select(F.lit("late").alias("text")).write.parquet(folder + "/out/batch=4")
    assert [r["text"] for r in arrivals.published_rows(spark, folder + "/out", folder + "/book").collect()] == ["the a"]
    arrivals.take_csv(spark, [folder + "/in/gone.csv"], 5, **place)
    assert [r["status"] for r in arrivals.dead_files(spark, folder + "/book").collect()] == ["not_found"]
