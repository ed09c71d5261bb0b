"""Whitening components of embeddings by shifted CholeskyQR.

The centred rows of the fit list are a tall matrix A. Each pass sums the Gram matrix of the
current rows over all partitions, factors it as ``R' R`` (Cholesky), and the next pass turns
the rows by a triangular solve with R. The first Gram matrix gets a shift on its diagonal, so
that the factor exists however badly A is conditioned; the next passes repair the loss. Rows
are never stored between passes: a pass applies the solves with all factors so far to the
centred rows again. After ``PASSES`` passes A = Q R with R the product of the factors. The last
Gram matrix enters by its square root instead of a Cholesky factor, so directions without any
variance come out as zero. The SVD of R gives the components (right vectors) and, squared over
n, their variances.

Rows are centred as ``n * x - S`` in integers and divided by n afterwards. Only sums of one
number per dimension and Gram matrices reach the driver; their size is the dimension's, not
the table's.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped; entries
that a shorter vector lacks count as zero; repeated rows and equal vectors are one vector of
the fit list, but every row is returned; a null id stays null; with fewer than 4 dimensions
there are fewer components; a component without variance (below ``NO_VARIANCE`` of the first)
has a null ``whitened`` and takes no part in ``identity_error``; without any variance
``explained`` is null; a deviation beyond a long is null; an empty table gives an empty
result. Components have their largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm import grid
from motionlake.session import settle, ship_package

COMPONENTS = 4
PASSES = 3
#: Share of the first variance below which a component counts as without variance.
NO_VARIANCE = 1e-13
#: Rows of a batch that are turned at a time.
STEP = 4096
GRAM = "i int, row array<double>"
EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """What the passes found; everything has the size of the dimension."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Exact sums per dimension of one partition; rows are summed in steps that fit a long."""
    n, sums = 0, [0] * dim
    for batch in batches:
        x = grid.matrix(batch.column("x"), dim)
        n += len(x)
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        part = x.sum(axis=0) if most * len(x) < 2**62 else x.astype(object).sum(axis=0)
        sums = [a + int(b) for a, b in zip(sums, part)]
    if n:
        arrays = [pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim), pa.array(sums, EXACT)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "n", "s"])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Centred rows ``(n * x - S) / n``, and the sum of the squares of ``n * x - S``."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most < 2**63:
        whole = n * x - np.array(sums, dtype=np.int64)
        return whole / n, (whole * whole).sum(axis=1).tolist()
    if most < 2**63:
        whole = n * x - np.array(sums, dtype=np.int64)
        rows = whole.astype(object)
    else:
        rows = whole = n * x.astype(object) - np.array(sums, dtype=object)
    squares = ((rows * rows).sum(axis=1) if x.shape[1] else [0] * len(x))
    return (whole / n).astype(np.float64), [int(v) if v < 2**63 else None for v in squares]


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inverse(factor)`` for an upper triangle, by substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], factors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The Gram matrix of one partition's turned rows, one row per dimension."""
    dim = len(sums)
    total = np.zeros((dim, dim))
    any_rows = False
    for batch in batches:
        x = grid.matrix(batch.column("x"), dim)
        any_rows = any_rows or bool(len(x))
        for at in range(0, len(x), STEP):
            rows, _ = deviations(x[at : at + STEP], n, sums)
            for factor in factors:
                rows = solve(rows, factor)
            total += rows.T @ rows
    if any_rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total))], names=["i", "row"])


def _summed(parts: DataFrame, dim: int) -> np.ndarray:
    """The sum of partial matrices: entries are added before and after the shuffle."""
    entries = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = entries.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("row"))
    out = np.zeros((dim, dim))
    for r in rows.collect():
        out[r.i] = r.row
    return (out + out.T) / 2


def triangle(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift where asked, or where there is none without."""
    dim = len(gram)
    # The shift that shifted CholeskyQR proves enough: 11 (m n + n (n + 1)) u |A|^2.
    shift = 11 * (rows * dim + dim * (dim + 1)) * 2.0**-53 * max(float(np.linalg.norm(gram, 2)), np.finfo(float).tiny)
    shift = min(shift, float(np.linalg.norm(gram, 2)) * 1e-3 + np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 10


def vectors_of(table: DataFrame, column: str = "embedding") -> DataFrame:
    """All rows that remain, with ``x``; entries padded to one length."""
    rows = table.withColumn("_v", F.col(column).cast("array<double>")).where(grid.usable(F.col("_v")))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), grid.integers(F.col("_v")).alias("x"))


def _padded(x: Column, dim: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size(x)))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, passes: int = PASSES) -> Fit:
    """Components of the distinct vectors of ``rows(x)``; ``rows`` is read once per pass."""
    sums = rows.mapInArrow(partial(_sums, dim=dim), "i int, n bigint, s decimal(38,0)")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, exact = found[0].n, [int(r.s) for r in found]
    factors: list[np.ndarray] = []
    product = np.eye(dim)
    for k in range(passes):
        gram = _summed(rows.mapInArrow(partial(_gram, n=n, sums=exact, factors=factors), GRAM), dim)
        if k == passes - 1:
            values, turned = np.linalg.eigh(gram)
            product = (np.sqrt(np.maximum(values, 0))[:, None] * turned.T) @ product
            break
        factor = triangle(gram, n, shifted=k == 0)
        factors.append(factor)
        product = factor @ product
    _, singular, right = np.linalg.svd(product)
    vectors = right[:components]
    largest = np.abs(vectors).argmax(axis=1)
    signs = np.where(vectors[np.arange(len(vectors)), largest] < 0, -1.0, 1.0)
    return Fit(n, exact, vectors * signs[:, None], singular**2 / n, float((singular**2).sum() / n))


def _whitened(rows: np.ndarray, model: Fit) -> np.ndarray:
    """Projections over the root of the variances; NaN for components without variance."""
    e = model.variances[: len(model.components)]
    real = e > NO_VARIANCE * model.variances[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(real, (rows @ model.components.T) / np.sqrt(e), np.nan)


def _products(batches: Iterator[pa.RecordBatch], model: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of products of the whitened values of one partition."""
    dim, k = len(model.sums), len(model.components)
    total = np.zeros((k, k))
    for batch in batches:
        x = grid.matrix(batch.column("x"), dim)
        for at in range(0, len(x), STEP):
            w = np.nan_to_num(_whitened(deviations(x[at : at + STEP], model.n, model.sums)[0], model))
            total += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])


def identity_error(rows: DataFrame, model: Fit) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.components)
    real = model.variances[:k] > NO_VARIANCE * model.variances[0]
    if not real.any():
        return None
    covariance = _summed(rows.mapInArrow(partial(_products, model=model), GRAM), k) / model.n
    return float(np.abs(covariance - np.eye(k))[np.ix_(real, real)].max())


def _rows(batches: Iterator[pa.RecordBatch], model: Fit, error: float | None) -> Iterator[pa.RecordBatch]:
    dim, k = len(model.sums), len(model.components)
    explained = [float(e / model.total) if model.total > 0 else None for e in model.variances[:k]]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for batch in batches:
        centred, deviation = deviations(grid.matrix(batch.column("x"), dim), model.n, model.sums)
        w = _whitened(centred, model).ravel()
        m = batch.num_rows
        arrays = [
            batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
            pa.array(np.full(m * k, model.n)),
            pa.array([d for d in deviation for _ in range(k)], pa.int64()),
            pa.array(w, mask=np.isnan(w)),
            pa.array(explained * m, pa.float64()),
            pa.array([error] * (m * k), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def whiten(table: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component."""
    spark = table.sparkSession
    ship_package(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors_of(table)
    dim = rows.agg(F.max(F.size("x")).alias("dim")).first().dim or 0
    if not dim:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", _padded(F.col("x"), dim))
    fit_list = settle(rows.select("x").distinct())
    model = fit(fit_list, dim, components, passes)
    error = identity_error(fit_list, model)
    return rows.mapInArrow(partial(_rows, model=model, error=error), schema)
