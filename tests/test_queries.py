from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import check
from marginalia.plans import queries as plan_queries
from marginalia.sources import files as sources

SF = "/root/testdata/sf0.001"

# The slower queries are compared by check.py.
QUICK = [
    "skip_reason_rows", "skip_reason_variant", "skip_reason_share_by_file", "text_functions", "file_profile",
    "parse_labels", "multi_hot", "training_gate", "training_gate_verdict", "split_assign", "chunk_rows",
    "tokenize_truncate", "nb_scores", "scored_rows", "category_top5", "csv_scan", "file_precheck",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got == Counter(cursor.fetchall())


def test_a_folder_of_part_files_has_one_output_name(spark, folder):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = entry.queries()["file_names"](spark, folder).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [tuple(r) for r in found] == [("documents", ".parquet", "classified_documents_20240102_030405", rows)]


def test_awkward_files_are_written_by_all_tasks(spark, folder):
    """None of them is gathered in a fixed number of tasks."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(16).write.parquet(f"{folder}/documents.parquet")
    tasks = spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions()
    assert tasks > 3
    for path in plan_queries._awkward_files(spark, folder):
        assert sources.list_files(spark, [path]).filter("source_file LIKE 'part-%'").count() == tasks


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"idx", "category", "n", "pct"}


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
