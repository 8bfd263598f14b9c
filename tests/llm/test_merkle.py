"""The manifest against a plain tree, and against its SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from tests.llm.conftest import prose

from marginalia.llm import merkle, queries

NAMES = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, idx int, n int, run int, path string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Root and, for each node, the siblings on its way up as (left, right) by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, at in enumerate(where):
            run, slot = runs[at // 16], at % 16
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        where, nodes = [at // 16 for at in where], [h(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    """Multiset of the query's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, found = [], []
    for g in order:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), str(r)), r) for r in groups[g])
        sub, paths = climb([k[2] for k, _ in own])
        subs.append(sub)
        found.append([(r, k[2], p) for (k, r), p in zip(own, paths, strict=True)])
    root, above = climb(subs)
    out = []
    for sub, tail, own in zip(subs, above, found, strict=True):
        for (doc, text, lang, source, n, *_), digest, path in own:
            path = path + tail
            changed = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None
            folded = leaf(doc, source, lang, n, text.translate(LOWER) if changed else text)
            for left, right in path:
                folded = h(left, folded, right)
            proof = h(*(left + right for left, right in path))
            out.append((doc, digest, sub, root, proof, folded, folded == root))
    return Counter(out)


def run(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, NAMES).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return queries.QUERIES["op12_merkle_manifest"](spark, "")


def documents():
    hot = [(i, prose(i, 5).title(), "en", "hot", i, "a", "b", 1, 2, 3, "c") for i in range(300)]
    odd = [
        (500, None, None, "s", None), (501, "", "de", "s", 0), (None, "Null Id", "en", "s", 1), (None, None, None, None, None),
        (502, "A" * 300_000, "en", "é", 1), (503, "Same", "en", "t", 4), (503, "Same", "en", "t", 4), (503, "Other", "en", "t", 5),
        (504, "x", "en", "", 1), (505, "ÄÖ Upper", "en", None, 3), (7, "Seven", "en", "z", 1),
    ]
    few = [(600 + i, "T", "en", f"one{i:02d}", 1) for i in range(30)]
    return hot + [(*r, "a", "b", 1, 2, 3, "c") for r in odd + few]


def test_against_a_plain_tree_and_sql(spark, monkeypatch):
    rows = documents()
    got = run(spark, rows, monkeypatch)
    found = Counter(tuple(r) for r in got.collect())
    assert found == plain(rows)
    assert 0 < sum(not r[-1] for r in found.elements()) < len(rows)
    con = duckdb.connect()
    columns = {c: [r[i] for r in rows] for i, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])}
    con.register("documents", pa.table(columns))
    answer = con.sql(queries.SQL["op12_merkle_manifest"])
    wanted = [dict(zip(answer.columns, r, strict=True)) for r in answer.fetchall()]
    assert Counter(tuple(r[c] for c in got.columns) for r in wanted) == found


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes_of_one_group(spark, monkeypatch, n):
    rows = [(i, f"Text {i}", "en", None, i, "a", "b", 1, 2, 3, "c") for i in range(n)]
    assert Counter(tuple(r) for r in run(spark, rows, monkeypatch).collect()) == (plain(rows) if rows else Counter())


def test_any_change_changes_the_root(spark):
    rows = [r[:5] for r in documents()[:40]]
    names = "doc_id long, text string, lang string, source string, n_chars long"

    def root(rows):
        return merkle.manifest(spark.createDataFrame(rows, names)).groups.first()["root"]

    first = root(rows)
    assert first == root(list(reversed(rows)))
    assert first != root(rows[:-1]) and first != root([(*rows[0][:2], "fr", *rows[0][3:]), *rows[1:]])


def test_a_hot_group_is_spread(spark):
    """Windows and joins are dealt by (key, run), never by the key alone, but for counts by part."""
    df = spark.createDataFrame([r[:5] for r in documents()], "doc_id long, text string, lang string, source string, n_chars long")
    plan = merkle.manifest(df, keep={"doc_id": df["doc_id"]}).proofs("doc_id")._jdf.queryExecution().executedPlan().toString()
    dealt = {part.split("#")[0].strip() for line in plan.splitlines() if "hashpartitioning(" in line for part in [line.split("hashpartitioning(")[1]]}
    assert dealt == {"key"} and all("run#" in line or "idx#" in line for line in plan.splitlines() if "hashpartitioning(key" in line)
