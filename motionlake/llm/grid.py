"""Integer vectors, and cells in which every query chunk meets every shard of an index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components of one shard of an index, and queries of one chunk: together a cell's memory.
SHARD_COMPONENTS = 2**18
CHUNK_QUERIES = 256
LAST = 2**63 - 1
#: Scores end here on both sides, so that they can be negated and compared with no score.
MOST = LAST - 1


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def integers(vector: Column) -> Column:
    """Each component c as floor(256 * c); values beyond a long end at its limits."""
    return F.transform(vector, lambda c: F.floor(c * F.lit(float(SCALE))))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A column of integer lists as rows of one matrix; missing components are zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets)
    values = np.asarray(lists.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    most = int(sizes.max(initial=0)) if width is None else width
    if (sizes == most).all():
        return values.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), dtype=values.dtype)
    out[np.arange(most) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of integer arrays, exact: by double precision where every partial sum is
    below 2**53, else by unbounded integers; results end at ``MOST`` on both sides."""
    most, other = (max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b))
    if a.shape[-1] * max(most, 1) * max(other, 1) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if a.ndim == 2 and b.ndim == 2:
        exact = a.astype(object) @ b.astype(object)
    else:
        exact = np.array([x.astype(object) @ y.astype(object) for x, y in zip(a, b)], dtype=object).reshape(*a.shape[:-1], b.shape[-1])
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def chunks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def in_cells(queries: DataFrame, index: DataFrame, chunks: int, shards: int, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(query rows, index rows)`` for every chunk of queries and shard of the index.

    ``queries`` has ``chunk`` and ``index`` has ``shard``. Queries travel once per shard and
    index rows once per chunk; a cell holds one of each, whatever the sizes of the tables.
    """
    left = queries.withColumn("shard", each(shards))
    right = index.withColumn("chunk", each(chunks))
    return left.groupBy("chunk", "shard").cogroup(right.groupBy("chunk", "shard")).applyInArrow(kernel, schema)
