"""Whitening of embeddings: blockwise QR, then a bidiagonal qd solver for a matrix of the vectors' dimension.

1. Entries become integers, floor(64 c) + 1000000, so that counts, sums and squared deviations are exact.
2. Every task centres its rows ((n x - S) is exact, one division follows) and folds them, batch by batch, into one triangular factor by QR; the
   factors of FAN tasks at a time are stacked and factored again until one is left. No covariance is formed, so nothing is squared and lost.
3. The driver holds that one d x d factor: Householder bidiagonal form, dqds for the singular values, twisted factorisations for the vectors
   (evgraph.llm.bidiagonal).
4. Rows are projected inside tasks. The covariance of what comes out is measured over all rows: each task keeps count, mean and centred products,
   and these merge in the same tree as the factors.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped; so are vectors of another length than most have (ties: the
longer), as they have no place among the components; a null id stays; repeated rows count each; components whose variance is zero at double
precision do not exist, so equal vectors, one vector or an empty table give no rows; entries beyond +-2^40 are an error; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.bidiagonal import right_singular
from evgraph.llm.common import column
from evgraph.session import stored

SCALE, SHIFT, COMPONENTS, FAN, FAN_CELLS, BLOCK = 64, 1_000_000, 32, 32, 1 << 22, 1024


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>) of the vectors that count."""
    v = column(vector_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(v.isNotNull()).where(~odd)
    far = F.exists("v", lambda c: F.abs(c.cast("double")) > float(1 << 40))
    number = lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT
    rows = rows.select(column(id_col).alias("vec_id"), v.alias("v"))
    return rows.select("vec_id", F.when(far, F.raise_error(F.lit("an entry beyond 2^40 cannot be whitened"))).otherwise(F.transform("v", number)).alias("x"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        for k in range(0, len(pdf), BLOCK):
            part = pdf.iloc[k : k + BLOCK]
            yield part, np.stack(part["x"].to_numpy()).astype(np.int64)


def _tree(parts: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray], cells: int) -> np.ndarray | None:
    """parts (k, data), one row a task -> one array, by groups of FAN (of fewer where data is wide)."""
    fan = max(2, min(FAN, FAN_CELLS // max(1, cells)))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0] // fan], "data": [combine([np.asarray(x) for x in pdf.sort_values("k")["data"]])]})

    parts = stored(parts, "whitening-parts")
    most = parts.agg(F.max("k")).first()[0]
    while most:
        parts = stored(parts.groupBy(F.floor(F.col("k") / fan).alias("g")).applyInPandas(group, "k long, data array<double>"), "whitening-parts")
        most //= fan
    row = parts.select("data").first()
    return None if row is None else np.array(row["data"])


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def _merged(moments: list[np.ndarray], k: int) -> np.ndarray:
    """Count, means and centred products of several parts -> those of all."""
    out = moments[0].copy()
    for part in moments[1:]:
        n, m = out[0], part[0]
        apart = part[1 : k + 1] - out[1 : k + 1]
        out[k + 1 :] += part[k + 1 :] + np.outer(apart, apart).ravel() * (n * m / (n + m))
        out[1 : k + 1] += apart * (m / (n + m))
        out[0] = n + m
    return out


def principal(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """rows (x) -> n, the sums S, all variances (falling) and components (columns) of x."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = 0, None
        for _, x in _blocks(batches):
            n, s = n + len(x), x.sum(axis=0) if s is None else s + x.sum(axis=0)
        if n:
            yield pd.DataFrame({"n": n, "place": np.arange(len(s)), "s": s})

    found = rows.mapInPandas(sums, "n long, place int, s long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()  # a row a dimension
    if not found:
        return 0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))
    n, s = found[0]["n"], np.array([r["s"] for r in found], np.int64)
    d = len(s)

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for _, x in _blocks(batches):
            r = _factor([r, (n * x - s) / n])
        if len(r):
            yield pd.DataFrame({"data": [r.ravel()]})

    parts = rows.mapInPandas(factors, "data array<double>").select(F.spark_partition_id().cast("long").alias("k"), "data")
    r = _tree(parts, lambda blocks: _factor([b.reshape(-1, d) for b in blocks]).ravel(), d * d).reshape(-1, d)
    square = np.zeros((d, d))
    square[: len(r)] = r
    values, vectors = right_singular(square)
    return n, s, values / n, vectors


def _deviation(x: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of rows of integers."""
    if len(x) and float(np.abs(x).max()) ** 2 * x.shape[1] >= 2.0**62:
        x = x.astype(object)
    return [Decimal(int(v)) for v in (x * x).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector: vec_id, n, deviation (decimal, exact), whitened (array of the components' values), explained (array), identity_error."""
    rows = stored(entries(vectors, id_col, vector_col), "whitening-entries")
    usual = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (usual["d"] if usual else 0))
    n, s, variance, axes = principal(rows)
    k = min(components, len(variance))
    to = axes[:, :k] / np.sqrt(variance[:k])
    explained = (variance[:k] / variance.sum()).tolist() if k else []

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for _, x in _blocks(batches):
            z = (n * x - s) / n @ to
            mean = z.mean(axis=0)
            part = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])
            total = part if total is None else _merged([total, part], k)
        if total is not None:
            yield pd.DataFrame({"data": [total]})

    error = 0.0
    if k:
        parts = rows.mapInPandas(moments, "data array<double>").select(F.spark_partition_id().cast("long").alias("k"), "data")
        total = _tree(parts, lambda blocks: _merged(blocks, k), k * k)
        error = float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _blocks(batches):
            centred = n * x - s
            yield pd.DataFrame({"vec_id": part["vec_id"], "deviation": _deviation(centred), "whitened": list(centred / n @ to)})

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.where(F.lit(k > 0)).mapInPandas(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    constant = F.array(*[F.lit(x) for x in explained]) if k else F.array().cast("array<double>")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", constant.alias("explained"), F.lit(error).alias("identity_error"))


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The same with a row for each vector and component (from 1)."""
    found = whiten(vectors, id_col, vector_col, components)
    found = found.select("*", F.posexplode("whitened").alias("k", "value"))
    return found.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", "k").alias("explained"), "identity_error")
