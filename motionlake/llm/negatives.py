"""Hard negatives by Kronecker-packed integer products.

The components of up to ``PACK`` candidates in one dimension, biased to be non-negative, stand
in separated fields of one wide integer. An anchor multiplies each of these integers once by
its own biased component and adds them up; a field is wide enough for the largest sum, so no
carry reaches the next one, and the sum holds the product with every candidate at its place.
With bias b, dimension D and sums s, a score is ``field - b * s(anchor) - b * s(candidate) -
D * b * b``: exact, whatever the size of the components.

A pack holds candidates of one label. First anchors meet the packs of their label in cells:
the best rows are the positives. Then anchors with their positives meet all packs in cells,
those of their own label are passed over, and every (anchor, positive) keeps its best
candidates inside the window that the positive's score sets. Cells hold a chunk of anchors and
a shard of packs; large labels have many of both.

Edge cases: rows with a null label, a null vector or null or non-finite components take no
part; the components that a shorter vector lacks count as zero; rows that agree in id, label
and vector are one row; a null id is no anchor, is not divisible by anything and comes after
all other ids; scores end at +-(2**63 - 2); an anchor without another row of its label has no
positives and so no negatives; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import sumprod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm import grid
from motionlake.llm.common import document_key
from motionlake.session import settle, ship_package

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares of the positive's, in percent.
LOW, HIGH = 50, 95
#: Fixed values of the contract: anchors, and rows that move to the next of ten labels first.
EVERY, MOVED, LABELS = 50, 7, 10
PACK = 512
PACKED = "label bigint, keys array<bigint>, sums array<decimal(38,0)>, wide array<binary>"


def _packs(batches: Iterator[pa.RecordBatch], bias: int, dim: int, field: int) -> Iterator[pa.RecordBatch]:
    """Packs from rows (label, key, x) sorted by label and key."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        x = grid.matrix(rows.column("x"), dim)
        if field <= 8:
            shifted = (x + bias).T.astype("<u8").copy()
            cells = shifted.view(np.uint8).reshape(dim, len(x), 8)[:, :, :field]
            wide = [c.tobytes() for c in cells]
            sums = [int(v) for v in x.sum(axis=1)]
        else:
            wide = [b"".join((int(v) + bias).to_bytes(field, "little") for v in c) for c in x.T]
            sums = [sum(map(int, v)) for v in x]
        arrays = [
            pa.array([rows.column("label")[0].as_py()]),
            pa.array([rows.column("key").to_numpy()], pa.list_(pa.int64())),
            pa.array([sums], pa.list_(pa.decimal128(38, 0))),
            pa.array([wide], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["label", "keys", "sums", "wide"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows]).combine_chunks()
        cuts = [0, *(np.flatnonzero(np.diff(rows.column("label").to_numpy())) + 1).tolist(), rows.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            full = e if e < rows.num_rows else s + (e - s) // PACK * PACK
            for at in range(s, full, PACK):
                yield pack(rows.slice(at, min(PACK, full - at)))
        rest = rows.slice(full)
    if rest is not None and rest.num_rows:
        yield pack(rest)


class Pack:
    """One row of the packed table, ready to be multiplied."""

    def __init__(self, keys, sums, wide, bias: int, field: int):
        self.keys, self.bias, self.field = np.asarray(keys.values), bias, field
        self.wide = [int.from_bytes(w.as_py(), "little") for w in wide]
        exact = [int(v) for v in sums.as_py()]
        # What a score takes off besides the anchor's own part.
        self.off = [bias * s + len(self.wide) * bias * bias for s in exact]
        self.small = field <= 7 and max(map(abs, self.off), default=0) < 2**61
        if self.small:
            self.off = np.array(self.off)

    def scores(self, biased: list[int], total: int) -> np.ndarray:
        """Exact products with an anchor of biased components and the sum of its own ones."""
        n, field = len(self.keys), self.field
        raw = sumprod(biased, self.wide).to_bytes(n * field, "little")
        own = self.bias * total
        if self.small and abs(own) < 2**61:
            cells = np.zeros((n, 8), dtype=np.uint8)
            cells[:, :field] = np.frombuffer(raw, dtype=np.uint8).reshape(n, field)
            return cells.view("<i8")[:, 0] - self.off - own
        exact = (int.from_bytes(raw[i * field : i * field + field], "little") - int(self.off[i]) - own for i in range(n))
        return np.array([min(max(v, -grid.MOST), grid.MOST) for v in exact], dtype=np.int64)


def _best(keys: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((keys, -scores))[:n]
    return keys[top], scores[top]


def _anchors(anchors: pa.Table, dim: int, bias: int):
    x = grid.matrix(anchors.column("x"), dim).tolist()
    columns = (anchors.column(c).to_pylist() for c in ("q", "key", "label"))
    return [(q, key, label, [c + bias for c in v], sum(v)) for q, key, label, v in zip(*columns, x)]


def find_positives(anchors: pa.Table, packs: pa.Table, bias: int, dim: int, field: int, n: int) -> pa.Table:
    """The best ``n`` rows of a shard of the anchors' label, per anchor."""
    found: dict = {}
    people = _anchors(anchors, dim, bias) if packs.num_rows else []
    for row in zip(*(packs.column(c) for c in ("keys", "sums", "wide"))):
        pack = Pack(*row, bias, field)
        for q, key, _, biased, total in people:
            score = pack.scores(biased, total)
            other = pack.keys != key
            old = found.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            found[q] = _best(np.concatenate([old[0], pack.keys[other]]), np.concatenate([old[1], score[other]]), n)
    rows = [(q, k, s) for q, (keys, scores) in found.items() for k, s in zip(keys.tolist(), scores.tolist())]
    return pa.Table.from_pylist([dict(zip(("q", "key", "score"), r)) for r in rows], schema=pa.schema([(c, pa.int64()) for c in ("q", "key", "score")]))


def find_negatives(anchors: pa.Table, packs: pa.Table, bias: int, dim: int, field: int, n: int, low: int, high: int) -> pa.Table:
    """The best ``n`` rows of other labels inside each positive's window, per shard."""
    found: dict = {}
    people = _anchors(anchors, dim, bias) if packs.num_rows else []
    windows = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in anchors.column("positives").to_pylist()]
    for label, *row in zip(packs.column("label").to_pylist(), *(packs.column(c) for c in ("keys", "sums", "wide"))):
        pack = Pack(*row, bias, field)
        for (q, _, own, biased, total), window in zip(people, windows):
            if own == label:
                continue
            score = pack.scores(biased, total)
            near = np.flatnonzero((score >= min(w[0] for w in window)) & (score <= max(w[1] for w in window)))
            if not len(near):
                continue
            keys, score = pack.keys[near], score[near]
            for place, (least, most) in enumerate(window, 1):
                inside = (score >= least) & (score <= most)
                if inside.any():
                    old = found.get((q, place), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    both = np.concatenate([old[0], keys[inside]]), np.concatenate([old[1], score[inside]])
                    found[q, place] = _best(*both, n)
    rows = [(*at, k, s) for at, (keys, scores) in found.items() for k, s in zip(keys.tolist(), scores.tolist())]
    names = ("q", "place", "key", "score")
    return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(c, pa.int64()) for c in names]))


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """``key, label, x`` of the distinct rows that take part."""
    rows = vectors.select(
        document_key(F.col("vec_id")).alias("key"),
        label.cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    good = grid.usable(F.col("v")) & F.col("label").isNotNull()
    return rows.where(good).select("key", "label", grid.integers(F.col("v")).alias("x")).distinct()


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``key, label, x`` as ``integer_rows`` gives them; ``is_anchor`` is a condition on it.
    """
    ship_package(rows.sparkSession)
    rows = settle(rows)
    ends = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    dim, least, most = (v or 0 for v in ends)
    least, most = min(least, 0), max(most, 0)
    bias = -least
    #: Bytes of a field: the largest sum of products of biased components.
    field = max(1, -(-(dim * (most - least) ** 2).bit_length() // 8))
    terms = {"bias": bias, "dim": dim, "field": field}
    asked = settle(rows.where(is_anchor & (F.col("key") != grid.LAST)).withColumn("q", F.xxhash64("key", "label", "x")))
    sorted_rows = rows.repartitionByRange("label", "key", F.xxhash64("x")).sortWithinPartitions("label", "key")
    packs = sorted_rows.select("label", "key", "x").mapInArrow(partial(_packs, **terms), PACKED)
    packs = settle(packs.withColumn("pack", F.xxhash64("label", "keys", "wide")))
    per_shard = max(1, grid.SHARD_COMPONENTS // max(1, dim * PACK))

    in_label = packs.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / per_shard).alias("shards"))
    sizes = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / grid.CHUNK_QUERIES).alias("chunks")).join(in_label, "label")
    sizes = settle(sizes)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    left = asked.join(sizes, "label").withColumn("chunk", F.pmod("q", "chunks")).withColumn("n", F.col("shards")).withColumn("shard", every)
    right = packs.join(sizes, "label").withColumn("shard", F.pmod("pack", "shards")).withColumn("n", F.col("chunks")).withColumn("chunk", every)

    def same(a, b):
        return find_positives(a, b, n=positives, **terms)

    def different(a, b):
        return find_negatives(a, b, n=negatives, low=low, high=high, **terms)

    cell = ["label", "chunk", "shard"]
    met = left.select(*cell, "q", "key", "x").groupBy(*cell).cogroup(right.select(*cell, "keys", "sums", "wide").groupBy(*cell))
    close = met.applyInArrow(same, "q bigint, key bigint, score bigint")
    by_anchor = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    first = settle(close.withColumn("place", F.row_number().over(by_anchor).cast("bigint")).where(F.col("place") <= positives))
    listed = first.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("positives"))
    asked = settle(asked.join(listed, "q"))
    chunks = grid.chunks_of(asked.count(), grid.CHUNK_QUERIES)
    shards = grid.chunks_of(packs.count(), per_shard)
    anchors = asked.withColumn("chunk", F.pmod("q", F.lit(chunks)))
    index = packs.withColumn("shard", F.pmod("pack", F.lit(shards)))
    far = grid.in_cells(anchors, index, chunks, shards, different, "q bigint, place bigint, key bigint, score bigint")
    by_positive = Window.partitionBy("q", "place").orderBy(F.desc("score"), "key")
    ranked = far.withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= negatives)
    out = ranked.withColumnsRenamed({"key": "negative", "score": "negative_score"}).join(
        first.withColumnsRenamed({"key": "positive", "score": "positive_score"}), ["q", "place"]
    )

    def named(c):
        return F.when(F.col(c) != grid.LAST, F.col(c))

    out = out.join(asked.select("q", F.col("key").alias("anchor_id")), "q")
    return out.select(
        "anchor_id", named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), "positive_score", "negative_score"
    )


def mine(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """Hard negatives of the rows whose ``vec_id`` is divisible by ``every``, after some rows change their label."""
    label, vec_id = F.col("label").cast("bigint"), F.col("vec_id").cast("bigint")
    moved = F.when(vec_id % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    return hard_negatives(integer_rows(vectors, moved), F.col("key") % every == 0)


def oracle(every: int = EVERY) -> str:
    return f"""
WITH rows AS (
  SELECT DISTINCT vec_id,
    CAST(CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), parts AS (
  SELECT vec_id, label, unnest(x) AS c, unnest(range(len(x))) AS d FROM rows
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.c * c.c) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.d = c.d AND a.vec_id IS DISTINCT FROM c.vec_id
  WHERE a.vec_id % {every} = 0
  GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES}
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {NEGATIVES}
"""
