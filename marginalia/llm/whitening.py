"""Whitening of embeddings: exact covariance, float32 eigenvectors, refinement in higher precision.

Every entry ``c`` becomes the integer ``floor(1024 * c) + 100000``. Covariance: one pass gives the count and the
sum of every dimension, a second one the products of the entries less the rounded mean. Both are sums of integers that every
task adds up without rounding (products of limbs of 20 bits by a matrix product in floating point, which is
exact), so neither partitions nor repeated tasks change a bit of the result; what the rounded mean leaves over is
taken off exactly.

Eigenvectors: a float32 solver gives first ones. Each iteration of Ogita and Aishima corrects all of them by a few
matrix products in extended precision: the residual of orthogonality ``R = I - X'X`` and ``S = X'AX`` give
Rayleigh quotients ``d`` and the correction ``X + XE`` with ``E_ij = (S_ij + d_j R_ij) / (d_j - d_i)``. Where two
quotients are closer than the error of ``S``, that ratio says nothing: ``E_ij = R_ij / 2`` only makes the pair orthogonal, the span
of the whole cluster converges, and a small eigenproblem of ``X_c'(A - m)X_c``, shifted by the cluster's mean so that its
digits tell the members apart, turns the vectors inside it. Convergence is quadratic. Only the matrix of the
dimensions, whose size does not depend on the rows, gets to the driver.

Defined results: vectors that are null or empty or hold a null, a non-finite entry or one beyond ``LARGEST`` are dropped; of
several lengths the commonest counts (of equal ones the longest), the others are dropped, too; repeated rows and null ids count
as rows of their own; components without variance (a single vector, copies of one, more dimensions than
vectors) have null ``whitened`` values and are no part of ``identity_error``; no vectors give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from . import text as t
from .workers import ship

SCALE, SHIFT = 1024.0, 100_000
LARGEST = 2.0**40
LIMB = 20
ROWS = 4096  # limbs of 20 bits and 4096 rows: sums of products stay below 2**53
MOST_ITERATIONS = 30
WIDE = np.longdouble
_DECIMAL = pa.decimal128(38, 0)


class Whitening(NamedTuple):
    n: int
    centre: np.ndarray  # rounded mean of every dimension, integers
    rest: np.ndarray  # sum of every dimension less n times its centre, integers
    vectors: np.ndarray  # (dimensions, components), double
    values: np.ndarray  # eigenvalues, falling
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def columns(self) -> np.ndarray:
        """What a centred vector is multiplied with; NaN for components without variance."""
        floor = len(self.centre) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.where(self.values > floor, self.vectors / np.sqrt(np.where(self.values > floor, self.values, 1)), np.nan)


def finite(vector: str) -> Column:
    """Is the vector there, not empty and free of null, non-finite and too large entries?"""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """``(rows, dimensions)`` of lists of one length."""
    entries, _ = t.flat_list(column)
    entries = np.floor(SCALE * np.asarray(entries, dtype=np.float64)).astype(np.int64) + SHIFT
    return entries.reshape(len(column), -1)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact ``y'y`` of at most ``ROWS`` rows, as Python integers."""
    limbs, left = [], y
    while not limbs or left.any():
        if np.abs(left).max(initial=0) <= 1 << LIMB:
            limbs.append(left.astype(np.float64))
            break
        limbs.append((left & ((1 << LIMB) - 1)).astype(np.float64))
        left = left >> LIMB
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a, one in enumerate(limbs):
        for b, other in enumerate(limbs):
            total += (one.T @ other).astype(np.int64).astype(object) << (LIMB * (a + b))
    return total


def squares(d: np.ndarray) -> list[int]:
    """Exact sum of the squares of every row of integers."""
    if np.abs(d).max(initial=0) < 1 << 50 and d.shape[1] <= 1 << 12:
        high, low = d >> 25, d & ((1 << 25) - 1)
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(int(a) << 50) + (int(b) << 26) + int(c) for a, b, c in zip(*parts, strict=True)]
    return [sum(int(v) ** 2 for v in row) for row in d]


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(length, i, n, total)``: the task's count and sums of every dimension, by length of the vectors."""
    found: dict[int, list] = {}
    for batch in batches:
        lengths = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            x = integers(batch.column("vector").filter(pa.array(lengths == length)))
            own = found.setdefault(int(length), [0, np.zeros(int(length), dtype=object)])
            own[0] += len(x)
            own[1] += x.sum(axis=0).astype(object)  # at most 2**51 times the rows of a batch
    for length, (n, total) in found.items():
        columns = [[length] * length, range(length), [n] * length, [Decimal(int(v)) for v in total]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), _DECIMAL)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["length", "i", "n", "total"]
        )


def _multiplier(centre: np.ndarray) -> Callable:
    """``(i, j, total)``: the task's sums of products of centred entries, ``i <= j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                own = gram(integers(batch.column("vector").slice(start, ROWS)) - centre)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(centre))
            sums = pa.array([Decimal(int(v)) for v in total[i, j]], _DECIMAL)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), sums], ["i", "j", "total"]
            )

    return run


def _wide(value: int) -> np.longdouble:
    """The integer with all digits that extended precision holds."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - int(high)))


def first_vectors(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a float32 solver, rising eigenvalues."""
    size = float(np.abs(a).max(initial=0)) or 1.0
    return np.linalg.eigh((a / size).astype(np.float32))[1].astype(WIDE)


def _quotients(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    return r, s, np.diag(s) / (1 - np.diag(r))


def clusters(d: np.ndarray, width: np.longdouble) -> list[np.ndarray]:
    """Groups of two or more quotients whose neighbours in order are at most ``width`` apart."""
    order = np.argsort(d)
    cuts = np.flatnonzero(np.diff(d[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and values of the symmetric ``a`` from first vectors ``x``, both in extended precision."""
    norm, unit = np.sqrt((a * a).sum()), np.finfo(WIDE).eps
    for _ in range(MOST_ITERATIONS):
        r, s, d = _quotients(a, x)
        off = s - np.diag(d)
        width = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        width = max(width, norm * np.sqrt(unit))  # closer ones would turn rounding into corrections
        gap = d[None, :] - d[:, None]
        close = np.abs(gap) <= width
        e = np.where(close, r / 2, (s + d[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        found = clusters(d, width)
        turned = False
        for own in found:
            part, middle = x[:, own], d[own].mean()
            small = part.T @ (a @ part) - middle * (part.T @ part)
            size = np.abs(small - np.diag(np.diag(small))).max(initial=0)
            if size > 16 * len(a) * unit * norm:  # below that the members are one eigenvalue, any basis is right
                turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))[1]
                x[:, own] = part @ turn.astype(WIDE)
                turned = True
        if not turned and np.abs(e).max(initial=0) <= 2.0**-58:
            break
    x = x + x @ _quotients(a, x)[0] / 2
    return x, _quotients(a, x)[2]


def eigen(a: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``components`` unit eigenvectors, falling eigenvalues; the largest entry of each is positive."""
    x, d = refined(a, first_vectors(a))
    order = np.argsort(-d, kind="stable")[:components]
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], 0) < 0, -1, 1)
    return x.astype(np.float64), d[order].astype(np.float64)


def covariance(n: int, rest: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Divisor ``n``, from the exact sums of products about the centre and what the centre leaves over."""
    exact = n * products - np.outer(rest, rest)
    return np.frompyfunc(_wide, 1, 1)(exact).astype(WIDE) / (WIDE(n) * WIDE(n))


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.filter(finite("vector"))


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """From all rows of ``prepared``; None without any."""
    ship(rows.sparkSession)
    sums = rows.select("vector").mapInArrow(_summer, "length int, i int, n long, total decimal(38,0)")
    sums = sums.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow().to_pylist()
    if not sums:
        return None
    n, length = max((s["n"], s["length"]) for s in sums)
    total = np.zeros(length, dtype=object)
    for s in sums:
        if s["length"] == length:
            total[s["i"]] = int(s["total"])
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    rest = total - n * centre.astype(object)
    sized = rows.select("vector").filter(F.size("vector") == length)
    found = sized.mapInArrow(_multiplier(centre), "i int, j int, total decimal(38,0)")
    found = found.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    products = np.zeros((length, length), dtype=object)
    products[i, j] = products[j, i] = [int(v) for v in found.column("total").to_pylist()]
    a = covariance(n, rest, products)
    vectors, values = eigen(a, min(components, length))
    return Whitening(n, centre, rest, vectors, values, float(np.trace(a)))


def _projector(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        project, mean = w.columns(), (w.rest / w.n).astype(np.float64)
        reach = float(np.abs(w.rest).max(initial=0)) + 1
        for batch in batches:
            y = integers(batch.column("vector")) - w.centre
            narrow = np.abs(y).max(initial=0) * float(w.n) + reach < 2.0**62
            d = y * w.n - w.rest.astype(np.int64) if narrow else y.astype(object) * w.n - w.rest
            exact = [Decimal(v) if v < 10**38 else None for v in squares(d)]
            z = (y - mean) @ project
            lists = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            bounds = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(exact, _DECIMAL), pa.ListArray.from_arrays(bounds, lists)],
                ["id", "deviation", "whitened"],
            )

    return run


def transform(rows: DataFrame, whitening: Whitening) -> DataFrame:
    """``(id, deviation, whitened)`` for every row of ``prepared`` that has the fitted length, one entry a component."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(whitening)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return rows.filter(F.size("vector") == len(whitening.centre)).mapInArrow(_projector(shared), kind)


def identity_error(whitened: DataFrame, whitening: Whitening) -> float:
    """Largest entry of the covariance of ``whitened`` less the identity, over the components that have variance."""
    valid = np.flatnonzero(~np.isnan(whitening.columns()).any(axis=0)).tolist()
    pairs = [(i, j) for i in valid for j in valid if i <= j]
    if not pairs:
        return 0.0
    each = [F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    row = whitened.agg(*each).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component."""
    rows = prepared(vectors, id_col, vector_col)
    found = fit(rows, components)
    if found is None:
        kind = rows.schema["id"].dataType.simpleString()
        columns = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], columns)
    # Written, so that the error is that of the values returned.
    done = materialise(transform(rows, found), "whitened")
    error = identity_error(done, found)
    explained = F.array(*[F.lit(float(v)) for v in found.explained])
    return done.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
