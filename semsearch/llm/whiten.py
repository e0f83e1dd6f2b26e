"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X are orthogonalised by passes over the table: every pass takes each
row through the triangular solves of the factors so far and sums the Gram matrix of
what comes out; its Cholesky factor is the next one.  The first Gram matrix is
shifted, so that ill-conditioned tables have a factor too.  With X = Q R, where R is
the product of the factors and Q has orthonormal columns, the singular values and
right singular vectors of R are those of X: components and variances of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Passes at most, and how far the last Gram matrix may be from the identity for its factor to end them.
PASSES, ORTHONORMAL = 6, 1e-10

#: A standard deviation below this share of the largest one is rounding: there is no variance.
NO_VARIANCE = 1e-11

#: Numbers (rows x dimensions) that a task takes through the solves at once.
AT_ONCE = 1 << 20

WHITENED = "vec_id long, component int, deviation long, whitened double"


@dataclass(frozen=True)
class Whitening:
    """What a table of n distinct vectors gave: exact sums, unit components by falling variance, total variance, error of the result."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and x, the whole numbers floor(scale * c) of each vector.

    Vectors that are null, empty or hold null or non-finite entries go.  Of several
    lengths the one of most rows stays (of equally many the longest): vectors of
    another length lie in another space.  Rows without an id and repeated rows stay.
    """
    vector = df[vector_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("vec_id"), vector.alias("v")).where(
        (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is not None:
        rows = rows.where(F.size("v") == lengths.dims)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _rows(column: pa.ListArray, dims: int):
    """Parts of a column of vectors as matrices of whole numbers."""
    step = max(1, AT_ONCE // dims)
    for a in range(0, len(column), step):
        yield a, column[a : a + step].flatten().to_numpy().reshape(-1, dims)


def _solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows * factor^-1 for an upper triangular factor, column after column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows, and the exact sum of every entry: one row per dimension comes to the driver."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
                n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[n], total]))], names=["at", "value"])

    found = {r.at: r.value for r in vectors.select("x").mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return found.get(-1, 0), np.array([found[i] for i in range(len(found) - 1)], np.int64)


def _gram(vectors: DataFrame, dims: int, through) -> np.ndarray:
    """Sum over all rows of the outer product of ``through(x)`` with itself; dims^2 / 2 numbers come to the driver."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in _rows(batch.column(0), dims):
                rows = through(x)
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    parts = vectors.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    size = max(r.j for r in parts) + 1
    gram = np.zeros((size, size))
    for r in parts:
        gram[r.i, r.j] = gram[r.j, r.i] = r.value
    return gram


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the numerator is exact."""
    return (n * x - sums) / n


def fit(vectors: DataFrame, k: int = 4, passes: int = PASSES) -> Whitening:
    """Components of the distinct vectors of ``integers``.

    A table of few numbers per task and dimension is all that is shuffled, besides the
    vectors themselves once to find the distinct ones (formed before the shuffle, so a
    vector in a third of all rows is a row per task).  No rows: n is 0.
    """
    distinct = stored(vectors.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct-vectors")
    n, sums = _sums(distinct)
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    dims = len(sums)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centred(x, n, sums)
        for factor in factors:
            rows = _solve(rows, factor)
        return rows

    for p in range(passes):
        gram = _gram(distinct, dims, orthogonal)
        if p == 0 and not gram.any():
            factors.append(np.zeros((dims, dims)))  # a single vector
            break
        near = np.abs(gram - np.eye(dims)).max() < ORTHONORMAL
        if near or p == passes - 1:
            factors.append(_root(gram))
            break
        # the shift of the first pass; later ones only where a direction has no variance
        shift = 11 * (n * dims + dims * (dims + 1)) * 2**-53 * np.trace(gram)
        factors.append(_cholesky(gram + shift * np.eye(dims)) if p == 0 else _cholesky(gram, shift))
    r = np.eye(dims)
    for factor in factors:
        r = factor @ r
    _, singular, right = np.linalg.svd(r)
    singular = np.where(singular <= singular[0] * NO_VARIANCE, 0.0, singular)
    variances, components = singular**2 / n, right * np.where(right[np.arange(dims), np.abs(right).argmax(1)] < 0, -1.0, 1.0)[:, None]
    found = Whitening(n, sums, components[:k], variances[:k], float(variances.sum()))
    return Whitening(n, sums, found.components, found.variances, found.trace, _identity_error(distinct, found))


def _cholesky(gram: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Upper factor; with ``shift`` a matrix that has none gets it, in growing measure."""
    add = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + add * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            add = max(add * 10, shift, 2**-50)


def _root(gram: np.ndarray) -> np.ndarray:
    """Some F with F^T F = gram: the Cholesky factor, or where directions have no variance the spectral one."""
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(gram)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def _project(rows: np.ndarray, w: Whitening) -> np.ndarray:
    spread = np.sqrt(w.variances)
    return np.divide(rows @ w.components.T, spread, out=np.zeros((len(rows), len(spread))), where=spread > 0)


def _identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, over components with variance."""
    with_mean = lambda x: np.concatenate([np.ones((len(x), 1)), _project(centred(x, w.n, w.sums), w)], 1)
    moments = _gram(distinct, w.dims, with_mean) / w.n
    error = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(len(w.variances))
    some = w.variances > 0
    return float(np.abs(error[some][:, some]).max(initial=0.0))


def transform(vectors: DataFrame, w: Whitening) -> DataFrame:
    """``WHITENED`` rows of ``integers``: one per vector and component.

    ``deviation`` is the exact sum of (n * x - sums)^2 (null if that is beyond a
    long); a component without variance has ``whitened`` 0.  No shuffle.
    """
    k = len(w.variances)

    def run(batches):
        for batch in batches:
            for a, x in _rows(batch.column(1), max(1, w.dims)) if k else ():
                exact = w.n * x - w.sums
                fits = ((w.n * x.astype(float) - w.sums) ** 2).sum(1) < 2.0**63 * 0.99
                deviation = pa.array((exact * exact).sum(1), mask=~fits)
                of = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a : a + len(x)].take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(pa.array(of)), pa.array(_project(exact / w.n, w).ravel())],
                    names=["vec_id", "component", "deviation", "whitened"],
                )

    return vectors.select("vec_id", "x").mapInArrow(run, WHITENED)


def explained(w: Whitening) -> Column:
    """Share of the total variance of the row's ``component``; 0 if there is none."""
    shares = [float(e / w.trace) if w.trace > 0 else 0.0 for e in w.variances]
    return F.element_at(F.array(*map(F.lit, shares)), F.col("component")) if shares else F.lit(0.0)


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (1 to k, at most as many as there are dimensions), n, deviation, whitened, explained, identity_error.

    See ``integers`` for rows that take no part; repeated rows are whitened as often as
    they occur and count once in the fit.  A table without vectors gives no rows; a
    single distinct vector has no variance: whitened and explained are 0.
    """
    vectors = integers(df, id_col, vector_col)
    w = fit(vectors, k)
    return transform(vectors, w).select(
        "vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained(w).alias("explained"), F.lit(w.identity_error).alias("identity_error")
    )
