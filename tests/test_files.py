import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.errors import MissingColumnError
from marginalia.sinks import tables as sinks
from marginalia.sources import files, spanning
from marginalia.sources.labelled import read_labelled


def put(folder, name, content, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode(encoding))
    return path


def texts(df):
    return sorted((r["text"] or "-") for r in df.collect())


def test_columns_are_bound_by_name(spark, folder):
    a = put(folder, "a.csv", "text,x\nok,1\n")
    b = put(folder, "b.csv", "text,x\n")
    c = put(folder, "c.csv", "y,text\n9,reordered\n")
    rows = files.read_csv(spark, [a, b, c])
    assert texts(rows) == ["ok", "reordered"]
    assert rows.columns[0] == "source_file" and {"x", "y"} < set(rows.columns)
    report = {r["source_file"]: (r["status"], r["n_rows"]) for r in files.validate_files(spark, [a, b, c]).report.collect()}
    assert report == {"a.csv": ("ok", 1), "b.csv": ("no_data", 0), "c.csv": ("ok", 1)}


def test_quotes_newlines_blanks_and_encodings(spark, folder):
    plain = put(folder, "q.csv", 'text,x\n"two\nlines ""q"" \\ back",1\n,2\n"",3\n"  padded ",4\n')
    latin = put(folder, "l.csv", "text,x\ncafé,1\n", "latin-1")
    rows = files.read_csv(spark, [plain, latin])
    assert texts(rows) == ["  padded ", "-", "-", "café", 'two\nlines "q" \\ back']
    facts = {r["source_file"]: r["encoding"] for r in files.probe_encodings(spark, [plain, latin]).collect()}
    assert facts == {"q.csv": "utf-8", "l.csv": "latin-1"}


def test_invalid_byte_far_into_the_file(spark, folder):
    late = put(folder, "late.csv", b"text\n" + b"abcdefghi\n" * 5000 + b"caf\xe9\n")
    assert files.probe_encodings(spark, [late]).first()["encoding"] == "latin-1"
    assert files.read_csv(spark, [late]).filter("text = 'café'").count() == 1


@pytest.fixture
def small_splits(spark):
    """Parts of 16 KB, as a stand-in for large files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "16k")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_large_files_are_read_in_parts(spark, folder, small_splits):
    flat = put(folder, "flat.csv", "text,n\n" + "".join(f"row {i},{i}\n" for i in range(3000)))
    folded = put(folder, "folded.csv", "text,n\n" + "".join(f'"row\n{i}",{i}\n' for i in range(3000)))
    returns = put(folder, "returns.csv", "text,n\r" + "".join(f'"row\r{i}",{i}\r' for i in range(3000)))
    flat_rows, folded_rows = files.read_csv(spark, [flat]), files.read_csv(spark, [folded])
    assert flat_rows.rdd.getNumPartitions() > 1
    for rows in (flat_rows, folded_rows, files.read_csv(spark, [returns])):
        assert rows.selectExpr("count(*)", "sum(n)").first() == (3000, 4498500)
    lines = spanning.lines_with_steps(spark, [folded])
    assert lines.rdd.getNumPartitions() > 3
    assert {r["text"] for r in folded_rows.collect()} == {f"row\n{i}" for i in range(3000)}


def whole(spark, path, schema):
    """The rows as one task reads them."""
    reader = spark.read.options(**files.CSV_OPTIONS).option("multiLine", "true").option("columnPruning", "false")
    return Counter(tuple(r) for r in reader.option("columnNameOfCorruptRecord", "misfit").schema(schema).csv(path).collect())


@pytest.mark.parametrize("seed", range(6))
def test_parts_give_the_rows_of_a_whole_read(spark, folder, seed):
    """Fields of quotes, commas and line ends, well formed or not, cut anywhere."""
    draw = random.Random(seed)
    end = "\r\n" if seed == 2 else "\n"

    def field():
        text = "".join(draw.choice('ab,"\n é') for _ in range(draw.randint(0, 8)))
        quoted = draw.random() < 0.7 or any(c in text for c in ',"\n')
        return '"' + text.replace('"', '""') + '"' if quoted else text

    if seed % 2:  # quotes anywhere, but closed in the end
        body = "".join(draw.choice(['"', "a", "b", ",", "\n", '""', " "]) for _ in range(600)) + '\n"",1\n'
        body += '"' * (spanned(body) % 2) + "\n"
    else:
        body = "".join(f"{field()},{field()}{',more' * (draw.random() < 0.1)}{end}" for _ in range(120))
    path = put(folder, "f.csv", f"text,y{end}" + body)
    wanted = whole(spark, path, "text STRING, y STRING, misfit STRING")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_csv(spark, [path], misfit_col="misfit", split_bytes=0)
        got = Counter((r["text"], r["y"], r["misfit"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == wanted


def spanned(body):
    """Quoted fields left open at the end, by a walk over the characters."""
    state = "start"
    for c in body:
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing" and c == '"':
            state = "quoted"
        elif c in ",\n":
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "plain"
    return state == "quoted"


def test_parts_of_several_files_with_encodings_and_odd_headers(spark, folder, small_splits):
    latin = put(folder, "with space+.csv", "n,text\n" + "".join(f'{i},"é\n{i}"\n' for i in range(2500)), "latin-1")
    plain = put(folder, "b.csv", '\ufefftext,"a\nb"\n' + "".join(f'"ü\n{i}",{i}\n' for i in range(2500)))
    rows = files.read_csv(spark, [plain, latin])
    assert rows.columns == ["source_file", "file_path", "text", "a\nb", "n"]
    found = Counter((r["source_file"], r["text"], r["n"] or r["a\nb"]) for r in rows.collect())
    named = {"b.csv": "ü", rows.filter("n IS NOT NULL").first()["source_file"]: "é"}
    assert len(named) == 2 and found == Counter((f, f"{c}\n{i}", str(i)) for f, c in named.items() for i in range(2500))
    assert {r["file_path"] for r in rows.select("file_path").distinct().collect()} == {f"file:{plain}", f"file:{latin}"}
    report = {r["file_path"]: r["n_rows"] for r in files.validate_files(spark, [plain, latin]).report.collect()}
    assert set(report.values()) == {2500}


def test_many_files_keep_their_own_header(spark, folder, capsys):
    paths = [put(folder, f"f{i}.csv", f"text,c{i}\n" + "".join(f"t{i}-{j},{j}\n" for j in range(20))) for i in range(150)]
    facts = files.text_facts(spark, paths)
    facts.explain()
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert sorted(r["header"] for r in facts.collect()) == sorted(f"text,c{i}" for i in range(150))


def test_awkward_names(spark, folder):
    a = put(folder, "one/with space+plus%20.csv", "﻿text,,x,x\n1,2,3,4\n")
    b = put(folder, "two/with space+plus%20.csv", "text\nother\n")
    rows = files.read_csv(spark, [a, b])
    assert texts(rows) == ["1", "other"]
    assert {r["file_path"] for r in rows.select("file_path").collect()} == {"file:" + a, "file:" + b}
    report = files.validate_files(spark, [a, b]).report
    assert [r["status"] for r in report.collect()] == ["ok", "ok"]


def test_validation_isolates_bad_files(spark, folder):
    good = put(folder, "good.csv", "text\nfine\n")
    blank = put(folder, "blank.csv", "text,x\n,1\n,2\n")
    empty = put(folder, "empty.csv", "")
    lacking = put(folder, "lacking.csv", "other\n1\n")
    notes = put(folder, "notes.txt", "text")
    broken = put(folder, "broken.parquet", b"not parquet at all")
    lines = put(folder, "rows.json", '{"text": "js", "k": 1}\n{"text": null}\n')
    spark.createDataFrame([("pq",)], "text STRING").write.parquet(folder + "/p")
    spark.createDataFrame([(1,)], "other INT").coalesce(1).write.parquet(folder + "/o")
    parquet = [os.path.join(folder, d, f) for d in "po" for f in os.listdir(os.path.join(folder, d)) if f.endswith(".parquet") and os.path.getsize(os.path.join(folder, d, f))]
    paths = [good, blank, empty, lacking, notes, broken, lines, folder + "/gone.csv", *parquet]
    checked = files.validate_files(spark, paths)
    status = {r["file_path"]: r["status"] for r in checked.report.collect()}
    assert status[good] == status[blank] == status[lines] == "ok"
    assert status[empty] == "no_data" and status[lacking] == "missing_column"
    assert status[notes] == "unsupported_format" and status[folder + "/gone.csv"] == "not_found"
    assert status[broken] == "unreadable"
    assert sorted(s for p, s in status.items() if p in parquet) in (["missing_column", "ok"], ["missing_column", "no_data", "ok"])
    assert texts(checked.rows) == ["-", "-", "-", "fine", "js", "pq"]


def test_nothing_to_read(spark, folder):
    checked = files.validate_files(spark, [folder + "/gone.csv"])
    assert checked.report.first()["status"] == "not_found" and checked.rows.count() == 0
    assert files.list_files(spark, [folder + "/gone"]).count() == 0


def test_missing_column_is_an_error(spark, folder):
    path = put(folder, "a.csv", "x\n1\n")
    with pytest.raises(MissingColumnError):
        files.read_csv(spark, [path])
    with pytest.raises(MissingColumnError):
        files.read_csv(spark, [path], columns=["x"], encoding="utf-8")
    spark.range(1).write.parquet(folder + "/p.parquet")
    with pytest.raises(MissingColumnError):
        files.read_tables(spark, [folder + "/p.parquet"])


def test_known_layout_skips_the_probe(spark, folder):
    path = put(folder, "a.csv", "text,x\nok,1\n")
    assert texts(files.read_csv(spark, [path], columns=["text", "x"], encoding="utf-8")) == ["ok"]


def test_admission(spark):
    mb = 1024 * 1024
    rows = [("a.csv", ".csv", mb), ("b.csv", ".csv", 50 * mb), ("c.csv", ".csv", 100 * mb), ("d.txt", ".txt", 10)]
    got = files.admit_files(spark.createDataFrame(rows, "source_file STRING, suffix STRING, size_bytes BIGINT"))
    assert {r["source_file"]: r["rejected_for"] for r in got.collect()} == {
        "a.csv": None, "b.csv": None, "c.csv": "too_large", "d.txt": "unsupported_format"
    }


def test_listing(spark, folder):
    put(folder, "sub/x.CSV", b"a" * 1536 * 1024)
    row = files.list_files(spark, [folder]).first()
    assert (row["source_file"], row["suffix"], row["size_bytes"], row["size_mb"]) == ("x.CSV", ".csv", 1572864, 1.5)


def test_csv_round_trip(spark, folder):
    rows = [("a,b\n\"c\" \\ ;", ["x", "y"]), (" padded ", []), (None, ["z"]), ("Їжак\r\n", None)]
    df = spark.createDataFrame(rows, "text STRING, labels ARRAY<STRING>")
    sinks.save(df, folder + "/t", "csv")
    sinks.append(df.limit(1), folder + "/t", "csv")
    paths = [r["file_path"] for r in files.list_files(spark, [folder + "/t"]).filter("suffix = '.csv'").collect()]
    back = read_labelled(spark, paths)
    got = sorted((r["text"], r["labels"]) for r in back.collect())
    assert len(got) == 5
    assert ("", ["z"]) in got and (" padded ", []) in got and ("a,b\n\"c\" \\ ;", ["x", "y"]) in got
    assert ("Їжак\r\n", []) in got


def with_split_size(spark, size, read):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    "content", ["text,x\rhello\rworld,1\r", "text,x\r\na,1\r\nb,2\r\n", 'text,x\n5" pipe,1\n"q\r\nr",2\nend,3\n', 'text,x\n5" pipe,1\n6" rod,2\n']
)
def test_same_records_at_every_size(spark, folder, content):
    path = put(folder, "a.csv", content)
    read = lambda: sorted(map(tuple, files.read_csv(spark, [path]).select("text", "x").collect()), key=str)
    assert with_split_size(spark, "10", read) == with_split_size(spark, "128m", read)


def test_stray_quotes_leave_a_file_splittable(spark, folder):
    path = put(folder, "a.csv", "text,n\n" + "".join(f'{i}" pipe,{i}\n' for i in range(2000)))
    rows = with_split_size(spark, "4k", lambda: files.read_csv(spark, [path]).rdd.getNumPartitions())
    assert rows > 1 and not files.text_facts(spark, [path]).first()["spans_lines"]
    long = put(folder, "long.csv", 'text\n"' + "x" * 200_000 + '"\n')
    assert not files.text_facts(spark, [long]).first()["spans_lines"]


def test_headers_in_their_own_encoding_and_over_lines(spark, folder):
    latin = put(folder, "l.csv", "größe,text\n1,é\n", "latin-1")
    folded = put(folder, "f.csv", '"a\nb",text\n1,two\n')
    assert files.read_csv(spark, [latin], "größe").first()["größe"] == "1"
    row = files.read_csv(spark, [folded]).first()
    assert (row["a\nb"], row["text"]) == ("1", "two")


def test_records_that_do_not_fit_are_counted(spark, folder):
    path = put(folder, "a.csv", "text,x\nfine,1\nlong,2,surplus\nshort\n")
    checked = files.validate_files(spark, [path])
    assert tuple(checked.files.select("status", "n_rows", "n_misfits").first()) == ("ok", 3, 2)
    assert texts(checked.rows) == ["fine", "long", "short"] and files.MISFIT not in checked.rows.columns


def test_folders_are_reported_by_their_files(spark, folder):
    rows = spark.range(100).select(F.concat(F.lit("t"), "id").alias("text"))
    rows.repartition(4).write.parquet(folder + "/set.parquet")
    rows.write.option("header", True).csv(folder + "/plain")
    checked = files.validate_files(spark, [folder + "/set.parquet", folder + "/plain", folder + "/none"])
    assert [tuple(r)[1:] for r in checked.report.orderBy("file_path").collect()] == [
        ("none", "not_found", 0), ("plain", "ok", 100), ("set.parquet", "ok", 100)
    ]
    assert checked.rows.count() == checked.report.agg({"n_rows": "sum"}).first()[0] == 200


def test_a_damaged_file_is_an_error_and_not_a_shorter_file(spark, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"text": [f"row {i} {i * 7919 % 1000}" for i in range(20_000)], "x": list(range(20_000))})
    good, bad = folder + "/good.parquet", folder + "/bad.parquet"
    pq.write_table(table, good, row_group_size=4000, compression="none", use_dictionary=False)
    pq.write_table(table, bad, row_group_size=4000, compression="none", use_dictionary=False)
    place = pq.ParquetFile(bad).metadata.row_group(2).column(0)
    with open(bad, "r+b") as out:
        out.seek(place.data_page_offset)
        out.write(b"\xff" * 200)
    checked = files.validate_files(spark, [good, bad])
    assert {r["source_file"]: (r["status"], r["n_rows"]) for r in checked.report.collect()} == {
        "good.parquet": ("ok", 20_000), "bad.parquet": ("unreadable", 0)
    }
    assert checked.rows.count() == 20_000


def test_a_failing_write_leaves_the_old_table(spark, folder):
    sinks.save(spark.range(5), folder + "/t")
    with pytest.raises(Exception):
        sinks.save(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("id")), folder + "/t")
    assert spark.read.parquet(folder + "/t").count() == 5 and os.listdir(folder) == ["t"]
    sinks.save(spark.range(2), folder + "/t")
    assert spark.read.parquet(folder + "/t").count() == 2 and os.listdir(folder) == ["t"]


def test_equal_names_in_two_folders_stay_apart(spark, folder):
    from datetime import datetime

    a, b = put(folder, "a/x.csv", "text\none\n"), put(folder, "b/x.csv", "text\ntwo\nthree\n")
    path = sinks.save_per_file(files.read_csv(spark, [a, b]), folder + "/out", datetime(2024, 1, 2))
    written = spark.read.parquet(path).groupBy("output", "file_id").count().collect()
    assert sorted(r["count"] for r in written) == [1, 2] and len({r["output"] for r in written}) == 1


def test_surplus_labels_are_never_lost_silently(spark, folder):
    path = put(folder, "l.csv", 'comment,labels\nfoo,a\nbar,a,b\n"x,y","c, d"\nbaz,b,c,d\nshort\n')
    good = put(folder, "g.csv", 'comment,labels\nfoo,a\n"x,y","c, d"\nshort\n')
    assert {r["text"]: r["labels"] for r in read_labelled(spark, [good], "comment").collect()} == {"foo": ["a"], "x,y": ["c", "d"], "short": []}
    with pytest.raises(Exception, match="more fields than the header has: (bar,a,b|baz,b,c,d)"):
        read_labelled(spark, [good, path], "comment").collect()
    found = read_labelled(spark, [path], "comment", surplus_col="surplus").collect()
    assert {r["text"]: (r["labels"], r["surplus"]) for r in found} == {
        "foo": (["a"], None), "bar": (["a"], "bar,a,b"), "x,y": (["c", "d"], None), "baz": (["b"], "baz,b,c,d"), "short": ([], None),
    }


def test_an_unreadable_csv_file_is_a_status(spark, folder):
    good, lacking = put(folder, "a.csv", "text,id\nx,1\ny,2\n"), put(folder, "b.csv", "txet\nx\n")
    broken = put(folder, "c.csv", "text\nz\n")
    put(folder, ".c.csv.crc", "crc\0" + "\0" * 12)
    found = files.validate_files(spark, [good, lacking, broken])
    assert {r["source_file"]: (r["status"], r["n_rows"]) for r in found.report.collect()} == {
        "a.csv": ("ok", 2), "b.csv": ("missing_column", 0), "c.csv": ("unreadable", 0)
    }
    assert sorted(r["text"] for r in found.rows.collect()) == ["x", "y"]
    alone = files.validate_files(spark, [broken])
    assert [r["status"] for r in alone.report.collect()] == ["unreadable"] and alone.rows.count() == 0


@pytest.mark.parametrize("at_once", [1, 3, 10_000])
def test_records_are_put_together_where_they_are_read(spark, folder, monkeypatch, at_once):
    """Only the pieces at the ends of a task's lines are gathered, however many batches a task's lines come in."""
    draw = random.Random(at_once)
    wanted = ["text,n"] + [f'"{i}{chr(10) * draw.randint(0, 9)}é",{i}' for i in range(400)]
    path = put(folder, "f.csv", "\n".join(wanted) + "\n")
    seen = []
    assembled = spanning._assembled
    monkeypatch.setattr(spanning, "_assembled", lambda lines: seen.append(assembled(lines)) or seen[-1])
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": str(at_once)}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        blocks = spanning.lines_with_steps(spark, [path]).select("block").distinct().count()
        got = Counter(r["record"] for r in spanning.records(spark, [path]).collect())
        pieces = seen[0].filter("NOT (begun AND ended)").count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == Counter(wanted) and len(got) == 401
    assert blocks > 3 and 0 < pieces <= 2 * blocks
