"""Whitening against exact fractions and a plain eigenproblem."""

import math
from fractions import Fraction

import numpy as np
import pytest

from marginalia.llm import queries, whitening as w


def plain(vectors):
    """Integers, exact deviations and the exact covariance as fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, dims = len(x), range(len(x[0]))
    s = [sum(v[i] for v in x) for i in dims]
    deviation = [sum((n * v[i] - s[i]) ** 2 for i in dims) for v in x]
    centred = [[Fraction(n * v[i] - s[i], n) for i in dims] for v in x]
    v = [[sum(c[i] * c[j] for c in centred) / n for j in dims] for i in dims]
    return x, s, deviation, np.array([[float(q) for q in row] for row in v])


def frame(spark, rows):
    data = [(i, v, 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, n int, id string, component int").repartition(3)


def test_components_deviations_and_identity(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(0, 0.2, (300, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, [None] + [0.1] * 11), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (304, []), (305, [1.0, 2.0])]
    got = w.whiten(frame(spark, rows)).collect()
    x, s, deviation, v = plain(vectors)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == 300 * 8 and {r["n"] for r in got} == {300}
    assert {(r["id"], int(r["deviation"])) for r in got} == set(enumerate(deviation))
    centred = np.array(x) - np.array(s) / 300
    for k in range(8):
        mine = np.array([r["whitened"] for r in sorted((r for r in got if r["component"] == k + 1), key=lambda r: r["id"])])
        plainly = centred @ basis[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - plainly).max(), np.abs(mine + plainly).max()) < 1e-9
        assert math.isclose(next(r["explained"] for r in got if r["component"] == k + 1), values[k] / values.sum(), rel_tol=1e-12)
    assert {r["identity_error"] for r in got} == {max(r["identity_error"] for r in got)} and got[0]["identity_error"] < 1e-9


def test_partitions_do_not_change_a_bit(spark):
    vectors = np.random.default_rng(4).normal(0, 0.2, (200, 6)).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    one, many = (w.fit(w.prepared(df.repartition(k), "vec_id", "embedding")) for k in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip(one, many, strict=True))


@pytest.mark.parametrize("values", [[5, 5, 5, 1], [3, 3 + 1e-7, 3 + 2e-7, 1, 1 + 1e-12, 0], [1, 0.5, 0.25], [2, 2, 2], [1, 1 + 1e-6, 1e-6, 2e-6, 1e-9]])
def test_refinement_of_clusters(values):
    """Orthonormal to extended precision, residuals and eigenvalues right although float32 cannot part the clusters."""
    values = np.sort(np.array(values, dtype=float))
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0].astype(w.WIDE)
    for _ in range(3):  # orthonormal in extended precision
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    a = (q * values.astype(w.WIDE)) @ q.T
    x, d = w.refined((a + a.T) / 2, w.first_vectors(a))
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-17
    assert np.abs(a @ x - x * d).max() < 1e-17 * max(1, values.max()) * 10
    assert np.abs(np.sort(d) - values).max() < 1e-17 * max(1, values.max()) * 10


def test_float32_alone_is_not_enough():
    a = np.diag([1.0, 1 + 1e-6, 0.5]).astype(w.WIDE)
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    a = turn @ a @ turn.T
    rough = w.first_vectors(a)
    error = lambda x, d: float(np.abs(a @ x - x * d).max())
    assert error(rough, np.diag(rough.T @ a @ rough)) > 1e-9 > 1e-15 > error(*w.refined(a, rough))


def test_large_entries_are_exact():
    y = np.random.default_rng(0).integers(-(1 << 50), 1 << 50, (5, 3))
    exact = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
    assert w.gram(y).tolist() == exact
    for high in (10, 1 << 30, 1 << 49, 1 << 60):
        d = np.random.default_rng(1).integers(-high, high, (4, 5))
        assert w.squares(d) == [sum(int(v) ** 2 for v in row) for row in d]


def test_without_variance_and_without_rows(spark):
    same = w.whiten(frame(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in same)
    assert {r["identity_error"] for r in same} == {0.0}
    assert w.whiten(frame(spark, [(1, None)])).collect() == []
    line = w.whiten(frame(spark, [(i, [i * 0.1, 0.0, 1.0]) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    few = w.whiten(frame(spark, [(1, [1e9, -1e9]), (2, [-1e9, 1e9]), (3, [1e30, 1.0])])).collect()
    assert len(few) == 4 and {r["n"] for r in few} == {2} and {int(r["deviation"]) for r in few} == {8 * (1024 * 10**9) ** 2}


def test_query(spark, sf):
    got = queries.QUERIES["op11_whitening"](spark, sf).collect()
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    _, _, deviation, _ = plain(vectors)
    assert len(got) == 8 * len(vectors)
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == list(enumerate(deviation))
    assert got[0]["identity_error"] < 1e-9
