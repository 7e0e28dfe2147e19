"""Whitening against numpy's eigenvectors and exact integers; the qd solver on hard matrices; odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evgraph.llm.bidiagonal import bidiagonal, dqds, right_singular
from evgraph.llm.queries import queries
from evgraph.llm.whitening import whiten, whitened_rows
from evgraph.session import importable_by_workers
from tests.compare import SMALL

RNG = np.random.default_rng(0)
TURN = np.linalg.qr(RNG.normal(size=(40, 40)))[0]
MATRICES = {
    "plain": RNG.normal(size=(300, 24)),
    "graded": RNG.normal(size=(300, 24)) * np.logspace(0, -6, 24),
    "low rank": RNG.normal(size=(300, 4)) @ RNG.normal(size=(4, 24)),
    "few rows": RNG.normal(size=(5, 24)),
    "constant columns": np.hstack([RNG.normal(size=(50, 6)), np.zeros((50, 3))]),
    "equal values": np.eye(16),
    "clusters": np.repeat([5, 3, 3.0000001, 1], 10) * np.linalg.qr(RNG.normal(size=(90, 40)))[0] @ TURN,
    "one": RNG.normal(size=(30, 1)),
    "two": RNG.normal(size=(30, 2)),
    "zero": np.zeros((4, 4)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name]
    r = np.linalg.qr(a, mode="r")
    square = np.zeros((a.shape[1], a.shape[1]))
    square[: len(r)] = r
    values, v = right_singular(square)
    known = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == int((known > known[0] * 1e-24).sum() if known[0] else 0)
    np.testing.assert_allclose(values, known[: len(values)], rtol=1e-10)
    np.testing.assert_allclose(v.T @ v, np.eye(len(values)), atol=1e-10)
    if len(values):
        assert np.abs(a.T @ (a @ v) - v * values).max() <= 1e-12 * values[0] * len(a)


def test_small_values_keep_their_relative_accuracy():
    q, e = np.array([1.0, 1e-8, 1e-16, 1e-24]), np.array([1e-3, 1e-12, 1e-21])
    exact = [float(x) for x in reversed(sorted_roots(q, e))]
    np.testing.assert_allclose(dqds(q, e), exact, rtol=1e-12)


def sorted_roots(q, e):
    """Eigenvalues of the tridiagonal matrix by bisection on exact fractions."""
    from fractions import Fraction

    q, e = [Fraction(x) for x in q], [Fraction(x) for x in e]
    diagonal = [q[k] + (e[k - 1] if k else 0) for k in range(len(q))]
    square = [q[k] * e[k] for k in range(len(e))]

    def below(x):
        count, d = 0, Fraction(1)
        for k, a in enumerate(diagonal):
            d = a - x - (square[k - 1] / d if k else 0)
            d = d or Fraction(1, 10**80)
            count += d < 0
        return count

    out = []
    for k in range(len(q)):
        low, high = Fraction(0), Fraction(4)
        for _ in range(140):
            middle = (low + high) / 2
            low, high = (low, middle) if below(middle) > k else (middle, high)
        out.append(high)
    return out


def test_bidiagonal_form():
    a = RNG.normal(size=(9, 9))
    d, e, right = bidiagonal(a)
    b = np.diag(d) + np.diag(e, 1)
    np.testing.assert_allclose(np.linalg.svd(b, compute_uv=False), np.linalg.svd(a, compute_uv=False), rtol=1e-12)
    assert len(right) == 7


def brute(vectors, k):
    x = np.array([[int(np.floor(64.0 * float(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = n * x - s
    a = centred.astype(float) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return n, (centred * centred).sum(axis=1), e[::-1][:k], v[:, ::-1][:, :k], a, e.sum()


def held(out, vectors, ids, k):
    n, deviation, e, v, a, total = brute(vectors, k)
    z = a @ v / np.sqrt(e)
    w = np.array([out[i]["whitened"] for i in ids])
    assert [int(out[i]["deviation"]) for i in ids] == list(deviation) and {r["n"] for r in out.values()} == {n}
    np.testing.assert_allclose(out[ids[0]]["explained"], e / total, rtol=1e-8)
    sign = np.sign((w * z).sum(axis=0))
    np.testing.assert_allclose(w * sign, z, atol=1e-6)
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert error < 1e-8 and {r["identity_error"] < 1e-8 for r in out.values()} == {True}


def test_equals_eigenvectors(spark):
    importable_by_workers(spark)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    out = {r["vec_id"]: r for r in whiten(rows.repartition(70)).collect()}  # 70 factors: two rounds of the tree
    held(out, [v for _, v in given], [i for i, _ in given], 32)
    query = queries()["op13_embedding_whitening"](spark, SMALL)
    assert query.count() == 32 * len(given) and dict(query.dtypes)["deviation"] == "bigint"
    assert query.agg(F.min("component"), F.max("component")).first()[:] == (1, 32)


def test_odd_vectors(spark):
    importable_by_workers(spark)
    nan, inf = float("nan"), float("inf")
    good = [[float(x) for x in row] for row in RNG.normal(size=(20, 3))]
    rows = [(k, v) for k, v in enumerate(good)] + [(None, good[0]), (3, good[3])]
    odd = [(90, None), (91, [nan, 1.0, 1.0]), (92, [1.0, inf, 0.0]), (93, [1.0, None, 2.0]), (94, []), (95, [1.0]), (96, [1.0, 2.0, 3.0, 4.0])]
    schema = "vec_id long, embedding array<double>, x string, n string, k string"
    df = spark.createDataFrame([(*r, "?", "?", "?") for r in rows + odd], schema)
    out = whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    unique = spark.createDataFrame([(k, v, "", "", "") for k, (_, v) in enumerate(rows)], schema)
    held({r["vec_id"]: r for r in whiten(unique).collect()}, [v for _, v in rows], list(range(len(rows))), 3)


def test_no_variance_and_empty(spark):
    importable_by_workers(spark)
    schema = "vec_id long, embedding array<float>"
    assert whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whitened_rows(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitened_rows(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], schema)).count() == 0
    line = whitened_rows(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(9)], schema)).collect()
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0}
    with pytest.raises(Exception, match="2\\^40"):
        whitened_rows(spark.createDataFrame([(1, [1e20, 1.0]), (2, [0.0, 1.0])], schema)).count()


def test_large_deviation_is_exact(spark):
    importable_by_workers(spark)
    rows = [(1, [1e9, 3.0]), (2, [-1e9, 1.0]), (3, [5e8, 0.5])]
    out = {r["vec_id"]: int(r["deviation"]) for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert out == {k + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)} and max(out.values()) > 2**63
