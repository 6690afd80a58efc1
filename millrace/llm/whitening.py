"""Whitening of embeddings by a two-pass covariance.

A component c of a vector becomes the integer x = floor(scale * c) + offset. The first pass
adds up the x of every dimension exactly, which gives the mean. The second centres the
vectors at the mean rounded to an integer and adds up outer products, a NumPy matrix
product for every batch of rows, merged by treeAggregate; what the rounding leaves out,
(S/n - rounded)(S/n - rounded)^T, is subtracted afterwards, and that makes the centring
exact. All these sums are integers, exact in doubles below 2^53, so up to there the
covariance doesn't depend on how the rows lie in files. LAPACK's symmetric eigensolver
gives the components, whose d x 32 matrix goes to the tasks; a third pass measures the
covariance of what comes out.

The driver holds d x d matrices, d being the length of a vector: five at most at a time,
since the tree merges by fours.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part,
nor do those of another length than most (of equally common lengths the smaller one
counts); entries of an absolute value of 2^40 or more are an error; a null or repeated id
stays, each row for itself. Components whose eigenvalue is zero to double precision
(at most d * 2^-52 times the largest) can't be whitened and are left out, so equal
vectors alone give no rows. Of the two signs, a component has the one in which its
largest entry is positive, the first of such. An empty table gives an empty one. Columns named
like those that are added give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finite_vectors, shared_dir, table, tree_sum, written

LARGEST = float(1 << 40)


def block(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The vectors of a batch, a row each."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def over(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """What f gives for the vectors of all batches of a task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            if batch.num_rows:
                got = f(block(batch))
                out = got if out is None else out + got
        return out

    return run


@dataclass
class Whitening:
    """What whitens: n and S of the integer vectors, components as columns (1 / sqrt(e) is in them), eigenvalues, trace."""

    n: int
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((self.n * x - self.total) / self.n) @ self.components


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """From integer vectors `x` of one length; None where there are no rows or no component has a variance."""
    sums = tree_sum(rows.select("x"), over(lambda x: np.append(x.sum(0), len(x))))
    if sums is None:
        return None
    n, total = int(sums[-1]), sums[:-1].astype(np.int64)
    near = np.rint(total / n).astype(np.int64)

    def outer(x: np.ndarray) -> np.ndarray:
        y = (x - near).astype(np.float64)
        return y.T @ y

    left = (total - n * near) / n
    cov = tree_sum(rows.select("x"), over(outer)) / n - np.outer(left, left)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = np.flatnonzero(values > max(values[0], 0.0) * len(values) * np.finfo(float).eps)[:components]
    if not len(kept):
        return None
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(kept))])
    return Whitening(n, total, vectors / np.sqrt(values), values, float(np.trace(cov)))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows."""

    def outer(x: np.ndarray) -> np.ndarray:
        y = w(x)
        y = np.column_stack((y, np.ones(len(y))))
        return y.T @ y

    got = tree_sum(rows.select("x"), over(outer)) / w.n
    mean = got[-1, :-1]
    return float(np.abs(got[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """The sum of (n x - S)^2 of every row, exact at any size."""
    dev = w.n * x - w.total
    top = int(np.abs(dev).max(initial=0))
    return ((dev if top * top * dev.shape[1] < 1 << 63 else dev.astype(object)) ** 2).sum(1).tolist()


ADDED = {"n": T.LongType(), "deviation": T.DecimalType(38, 0), "whitened": T.ArrayType(T.DoubleType()), "explained": T.ArrayType(T.DoubleType()), "identity_error": T.DoubleType()}


def whiten(vectors: DataFrame, keep: list[str], vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """The columns `keep` of vectors, and for every vector n, deviation, whitened and explained (arrays by component), identity_error."""
    spark, keep = vectors.sparkSession, [c for c in keep if c not in ADDED]
    v = finite_vectors(vectors, keep, vector_col)
    whole = F.transform("v", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("an entry is too large to be whitened"))).cast("long"))
    names = [f"k{i}" for i in range(len(keep))]
    rows = written(v.select(*names, whole.alias("x")), shared_dir(spark), "whole")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("x") == (size[0] if size else 0))
    schema = T.StructType([T.StructField(c, rows.schema[k].dataType) for c, k in zip(keep, names, strict=True)] + [T.StructField(c, t) for c, t in ADDED.items()])
    w = fit(rows, components) if size else None
    if w is None:
        return spark.createDataFrame([], schema)
    error, share = identity_error(rows, w), w.values / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = block(batch), batch.num_rows
            at = pa.array(np.arange(m + 1, dtype=np.int32) * len(share))
            added = [
                pa.array(np.full(m, w.n)), pa.array(deviations(x, w), pa.decimal128(38, 0)), pa.ListArray.from_arrays(at, pa.array(w(x).ravel())),
                pa.ListArray.from_arrays(at, pa.array(np.tile(share, m))), pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *added], schema.names)

    return rows.mapInArrow(run, schema)


def op11_whiten(spark, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
