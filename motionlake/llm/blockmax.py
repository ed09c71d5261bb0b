"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integer impacts: a dimension with a positive query component is one term, with a
negative one another. The index cuts the vectors, in an order that keeps like ones together,
into blocks of ``BLOCK``. A block holds the maximum of each term (``high`` and ``low``
component per dimension) and its forward index (ids and vectors). The bound of a block is the
sum of its term maxima weighted by the query; blocks are visited by falling bound, all vectors
of a block are scored from its forward index, and a query is done when the bound of its next
block falls below its kth score. The order uses the nearest two of ``PIVOTS`` sampled vectors;
it decides how much is pruned, never what is found.

First every query looks for its ``SEEDS`` blocks of the highest bounds anywhere and scores
them: the kth score found there is a floor that all shards start from. Then shards of blocks
and chunks of queries meet in cells, and a cell returns at most k rows per query. Among equal
vectors only the k + 1 smallest ids can be in an answer; the others stay out of the index, so
thousands of copies are k + 1 rows.

Edge cases: vectors that are null or hold null or non-finite components take no part; the
components that a shorter vector lacks count as zero, so an empty vector scores 0 with all;
rows that agree in id and vector are one row; a candidate with the query's id is its own row; a
null id is no query and comes after all other ids; scores end at +-(2**63 - 2); no queries or
no candidates give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm import grid
from motionlake.llm.common import document_key
from motionlake.session import settle, ship_package

K = 5
#: Fixed value of the contract: the queries are the rows whose id is divisible by this.
EVERY = 50
BLOCK = 64
SEEDS = 4
#: Vectors sampled to order the index (those with the smallest hashes).
PIVOTS = 64
NOTHING = -grid.LAST
INDEX = "keys array<bigint>, x array<bigint>, width int, high array<bigint>, low array<bigint>"


def integer_rows(vectors: DataFrame) -> DataFrame:
    """``key, x`` of the distinct rows that take part."""
    rows = vectors.select(document_key(F.col("vec_id")).alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(grid.usable(F.col("v"))).select("key", grid.integers(F.col("v")).alias("x")).distinct()


def _places(batches: Iterator[pa.RecordBatch], pivots: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Adds the nearest two pivots as a place in the order of the index."""
    width = max(map(len, pivots))
    centres = np.array([p + [0] * (width - len(p)) for p in pivots], dtype=np.float64).T
    for batch in batches:
        x = grid.matrix(batch.column("x")).astype(np.float64)
        most = min(width, x.shape[1])
        score = x[:, :most] @ centres[:most]
        first = score.argmax(axis=1)
        score[np.arange(len(score)), first] = -np.inf
        place = first * len(pivots) + score.argmax(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], names=["key", "x", "place"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``BLOCK`` neighbours of one length, from rows in index order."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        x = grid.matrix(rows.column("x"))
        starts = range(0, len(x), BLOCK)
        keys = rows.column("key").to_numpy()
        columns = [
            pa.array([keys[s : s + BLOCK] for s in starts], pa.list_(pa.int64())),
            pa.array([x[s : s + BLOCK].ravel() for s in starts], pa.list_(pa.int64())),
            pa.array([x.shape[1]] * len(starts), pa.int32()),
            pa.array([x[s : s + BLOCK].max(axis=0) for s in starts], pa.list_(pa.int64())),
            pa.array([x[s : s + BLOCK].min(axis=0) for s in starts], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["keys", "x", "width", "high", "low"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        widths = rows.column("width").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), rows.num_rows]
        for s, e in zip(cuts[:-2], cuts[1:-1]):
            yield emit(rows.slice(s, e - s))
        whole = (cuts[-1] - cuts[-2]) // BLOCK * BLOCK
        if whole:
            yield emit(rows.slice(cuts[-2], whole))
        rest = rows.slice(cuts[-2] + whole)
    if rest is not None and rest.num_rows:
        yield emit(rest)


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """The settled index of ``rows(key, x)``: one row per block, with an id ``block``."""
    by_vector = Window.partitionBy("x").orderBy("key")
    needed = settle(rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).drop("r"))
    pivots = [list(r.x) for r in needed.where(F.size("x") > 0).orderBy(F.xxhash64("x"), "key").limit(PIVOTS).collect()]
    placed = needed
    if pivots:
        placed = needed.mapInArrow(partial(_places, pivots=pivots), "key bigint, x array<bigint>, place bigint")
    else:
        placed = needed.withColumn("place", F.lit(0).cast("bigint"))
    placed = settle(placed.withColumn("width", F.size("x")))
    order = ["width", "place", "key"]
    dealt = placed.repartitionByRange(*order, F.xxhash64("x")).sortWithinPartitions(*order)
    blocks = dealt.select("key", "x", "width").mapInArrow(_blocks, INDEX)
    return settle(blocks.withColumn("block", F.xxhash64("keys", "x")))


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sum of the weighted term maxima: (queries, blocks)."""
    most = min(q.shape[1], high.shape[1])
    a, b, c = q[:, :most], high[:, :most].T, low[:, :most].T
    return grid.products(np.concatenate([np.maximum(a, 0), np.minimum(a, 0)], axis=1), np.concatenate([b, c]))


def _best_blocks(queries: pa.Table, blocks: pa.Table, seeds: int) -> pa.Table:
    """The blocks of a shard with the highest bounds, per query."""
    names = ["q", "block", "bound"]
    if not queries.num_rows or not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    bounds = _bounds(grid.matrix(queries.column("x")), grid.matrix(blocks.column("high")), grid.matrix(blocks.column("low")))
    top = np.argsort(-bounds, axis=1, kind="stable")[:, :seeds]
    q = np.repeat(queries.column("q").to_numpy(), top.shape[1])
    block = blocks.column("block").to_numpy()[top].ravel()
    return pa.table([pa.array(x) for x in (q, block, np.take_along_axis(bounds, top, axis=1).ravel())], names=names)


def _first_scores(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k highest scores of one block, per row (q, key, x of the query; keys, x, width of the block)."""
    for batch in batches:
        best = []
        for row in zip(*(batch.column(c) for c in ("key", "query", "keys", "x", "width"))):
            key, query, keys, x, width = row[0].as_py(), *(np.asarray(v.values) for v in row[1:4]), row[4].as_py()
            most = min(len(query), width)
            score = grid.products(x.reshape(len(keys), width)[:, :most], query[:most, None])[:, 0][keys != key]
            best.append(np.sort(score)[::-1][:k])
        yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(best, pa.list_(pa.int64()))], names=["q", "best"])


def visit(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """Scores blocks by falling bound until no query's next bound reaches its kth score."""
    names = ["q", "key", "score"]
    if not queries.num_rows or not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    q = grid.matrix(queries.column("x"))
    own, floor = queries.column("key").to_numpy(), queries.column("floor").to_numpy()
    high, low = grid.matrix(blocks.column("high")), grid.matrix(blocks.column("low"))
    width = min(q.shape[1], high.shape[1])
    q = q[:, :width]
    keys = np.full((blocks.num_rows, BLOCK), grid.LAST)
    there = np.zeros((blocks.num_rows, BLOCK), dtype=bool)
    forward = np.zeros((blocks.num_rows, BLOCK, width), dtype=np.int64)
    for b, (ids, x, w) in enumerate(zip(blocks.column("keys"), blocks.column("x"), blocks.column("width").to_pylist())):
        n, most = len(ids), min(w, width)
        keys[b, :n], there[b, :n] = np.asarray(ids.values), True
        forward[b, :n, :most] = np.asarray(x.values).reshape(n, w)[:, :most]
    bounds = _bounds(q, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    score = np.full((len(q), k), NOTHING)
    found = np.full((len(q), k), grid.LAST)
    live = np.arange(len(q))
    for step in range(blocks.num_rows):
        at = order[live, step]
        go = bounds[live, at] >= np.maximum(floor[live], score[live, -1])
        live, at = live[go], at[go]
        if not len(live):
            break
        new = grid.products(forward[at], q[live][:, :, None])[:, :, 0]
        new[~there[at] | (keys[at] == own[live][:, None])] = NOTHING
        all_scores = np.concatenate([score[live], new], axis=1)
        all_keys = np.concatenate([found[live], keys[at]], axis=1)
        top = np.lexsort((all_keys, -all_scores), axis=-1)[:, :k]
        score[live], found[live] = np.take_along_axis(all_scores, top, axis=1), np.take_along_axis(all_keys, top, axis=1)
    row, place = np.nonzero((score > NOTHING) & (score >= floor[:, None]))
    return pa.table([queries.column("q").to_numpy()[row], found[row, place], score[row, place]], names=names)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query.

    Both tables have ``key, x`` with distinct rows, as ``integer_rows`` gives them.
    """
    ship_package(queries.sparkSession)
    index = build_index(candidates, k)
    asked = settle(queries.withColumn("q", F.xxhash64("key", "x")))
    size = index.agg(F.count(F.lit(1)), F.sum(F.col("width").cast("bigint") * BLOCK)).first()
    shards, chunks = grid.chunks_of(size[1] or 0, grid.SHARD_COMPONENTS), grid.chunks_of(asked.count(), grid.CHUNK_QUERIES)
    index = index.withColumn("shard", F.pmod("block", F.lit(shards)))
    asked = asked.withColumn("chunk", F.pmod("q", F.lit(chunks)))

    def seed(a, b):
        return _best_blocks(a, b, SEEDS)

    def score(a, b):
        return visit(a, b, k)

    bounds = grid.in_cells(asked, index.select("block", "high", "low", "shard"), chunks, shards, seed, "q bigint, block bigint, bound bigint")
    first = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SEEDS).select("q", "block")
    met = seeds.join(asked.select("q", "key", F.col("x").alias("query")), "q").join(index.drop("high", "low", "shard"), "block")
    scored = met.mapInArrow(partial(_first_scores, k=k), "q bigint, best array<bigint>")
    best = F.sort_array(F.flatten(F.collect_list("best")), asc=False)
    floors = scored.groupBy("q").agg(F.get(best, F.lit(k - 1)).alias("floor"))
    asked = settle(asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING))))
    found = grid.in_cells(asked, index, chunks, shards, score, "q bigint, key bigint, score bigint")
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    named = ranked.join(asked.select("q", F.col("key").alias("query_id")), "q")
    vec_id = F.when(F.col("key") != grid.LAST, F.col("key"))
    return named.select("query_id", "rank", vec_id.alias("vec_id"), "score")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` best rows for each row whose ``vec_id`` is divisible by ``every``."""
    rows = settle(integer_rows(vectors))
    return top_k(rows.where((F.col("key") % every == 0) & (F.col("key") != grid.LAST)), rows, k)


def oracle(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), parts AS (
  SELECT vec_id, unnest(x) AS c, unnest(range(len(x))) AS d FROM rows
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.c * c.c) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id IS DISTINCT FROM c.vec_id
  WHERE q.vec_id % {every} = 0
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
