from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marginalia.operators import model as nb
from marginalia.sinks import commits, models as store, published

from test_files import put
from test_model import labelled


def test_entries_are_created_once(spark, folder):
    path = f"{folder}/a log/{commits.entry_name(1)}"
    assert commits.newest(spark, folder + "/a log") == 0
    assert commits.put_if_absent(spark, path, '{"x": "ä"}') and not commits.put_if_absent(spark, path, '{"x": "b"}')
    assert [tuple(r) for r in commits.entries(spark, folder + "/a log", "x STRING").collect()] == [("ä", 1)]
    for name in ("part-00000-c000.json", "notes.json"):
        put(folder, "a log/" + name, '{"x": "stray"}')
    assert commits.newest(spark, folder + "/a log") == 1
    assert commits.entries(spark, folder + "/a log", "x STRING").count() == 1
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: commits.append_entry(spark, folder + "/a log", {"x": str(i)}), range(12)))
    assert sorted(numbers) == list(range(2, 14))
    kept = {r["version"]: r["x"] for r in commits.entries(spark, folder + "/a log", "x STRING").collect()}
    assert all(kept[n] == str(i) for i, n in enumerate(numbers)) and len(kept) == 13


def test_renaming_does_not_overwrite(spark, folder):
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = names(f"{folder}/log/{commits.entry_name(1)}")
    assert commits._rename(spark, target, names(f"{folder}/log/_1"), '{"x": "a"}')
    assert not commits._rename(spark, target, names(f"{folder}/log/_2"), '{"x": "b"}')
    assert [tuple(r) for r in commits.entries(spark, folder + "/log", "x STRING").collect()] == [("a", 1)]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_readers_always_find_a_whole_table(spark, folder, kind, monkeypatch):
    path = f"{folder}/table"
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    text = F.concat(F.lit('a "b"\n,'), F.col("id"))
    assert published.publish(spark.range(5).select("id", text.alias("text")), path, kind) == 1
    first = published.read_published(spark, path)
    want = [(i, f'a "b"\n,{i}') for i in range(5)]
    assert sorted(map(tuple, first.collect())) == want

    def dies(*args):
        raise KeyboardInterrupt

    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"), F.lit("x").alias("text"))
    with pytest.raises(Exception):
        published.publish(broken, path, kind)
    with monkeypatch.context() as patch:
        patch.setattr(published, "append_entry", dies)
        with pytest.raises(KeyboardInterrupt):
            published.publish(spark.range(2).select("id", F.lit("late").alias("text")), path, kind)
    assert sorted(map(tuple, published.read_published(spark, path).collect())) == want
    assert published.publish(spark.range(1).select("id", F.lit("new").alias("text")), path, kind) == 2
    assert sorted(map(tuple, first.collect())) == want
    assert sorted(map(tuple, published.read_published(spark, path, 1).collect())) == want
    assert [tuple(r) for r in published.read_published(spark, path).collect()] == [(0, "new")]
    assert published.drop_versions(spark, path, keep=[2]) == 1
    assert published.read_published(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path, 9)


def test_versions_keep_their_numbers_whatever_the_clocks_say(spark, folder, monkeypatch):
    class Late:
        now = staticmethod(lambda zone: _at(2031))

    class Early:
        now = staticmethod(lambda zone: _at(2001))

    def _at(year):
        from datetime import datetime

        return datetime(year, 1, 1)

    model = nb.fit(labelled(spark)[0])
    with monkeypatch.context() as patch:
        patch.setattr(store, "datetime", Late)
        assert store.save_model(model, folder, {"writer": "a"}) == 1
        patch.setattr(store, "datetime", Early)
        assert store.save_model(model, folder, {"writer": "b"}) == 2
    assert store.model_details(spark, folder, 1) == {"writer": "a"}
    assert store.model_details(spark, folder) == {"writer": "b"} and store.latest_version(spark, folder) == 2
