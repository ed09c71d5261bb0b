"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: every shingle of ``size`` words is hashed with XXH64 and each of the 64 bits
is set when more than half of the hashes set it.

Covering masks: bit ``i`` carries the vector ``i % (2**(r+1) - 1) + 1`` over GF(2); for each
non-zero vector ``v`` a table keeps the bits whose vector has an odd product with ``v``. Up
to ``r`` differing bits are ``r`` linear conditions on ``r + 1`` unknowns, so some ``v``
drops all of them: every pair within the radius collides in some table, with certainty.
For a radius of 3 or less, each table is refined by cutting its dropped bits into ``r + 1``
blocks, of which one is free of differences. With r = 2 a bucket then leaves 18 of 64 bits
open, which bounds the distinct fingerprints of a bucket whatever the corpus holds. For a
larger radius, large buckets are cut into paired blocks. Exact copies meet before both.

A bucket yields star edges of its own components, never its pairs. Nodes are distinct
fingerprints; component labels come from star contraction over all edges.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated
rows, and rows with the same id, are separate rows; a null id counts as the largest id, and
a component is null only if no other id is reachable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import document_key, paired_blocks
from motionlake.llm.components import connected_components
from motionlake.session import settle, ship_package

BITS = 64
SEED = 42
#: Shingles hashed at a time; bounds the memory of one very long text.
STEP = 1 << 15
#: Rows of a chunk when a bucket is cut into paired blocks.
BUCKET_ROWS = 1024


def fingerprint(text: str | None, size: int) -> int:
    """SimHash of one whole text over ``size``-word shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), SEED)
    votes = np.zeros(BITS, dtype=np.int64)
    n = len(words) - size + 1
    for start in range(0, n, STEP):
        part = words[start : start + STEP + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], dtype=np.uint64)
        columns = [*(batch.column(k) for k in ("doc_id", "key", "version")), pa.array(prints.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "version", "fp"])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, key, version`` (text digest) and ``fp`` (the 64 bits as a bigint) per row."""
    ship_package(docs.sparkSession)
    doc_id = F.col("doc_id").cast("bigint")
    plain = docs.select(
        doc_id.alias("doc_id"), document_key(doc_id).alias("key"), F.xxhash64("text").alias("version"), "text"
    )
    return plain.mapInArrow(partial(_fingerprints, size=size), "doc_id bigint, key bigint, version bigint, fp bigint")


def covering_masks(radius: int, refined: bool = True) -> list[int]:
    """Bit masks such that two prints within ``radius`` bits agree under one of them."""
    space = 2 ** (radius + 1)
    masks = []
    for v in range(1, space):
        kept = [i for i in range(BITS) if (i % (space - 1) + 1 & v).bit_count() % 2]
        dropped = [i for i in range(BITS) if i not in set(kept)]
        if not refined:
            masks.append(sum(1 << i for i in kept))
            continue
        for block in range(radius + 1):
            masks.append(sum(1 << i for i in kept + dropped[block :: radius + 1]))
    return masks


def _bucket_links(prints: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct prints of one bucket that span its components."""
    n = len(prints)
    open_bits = [1 << i for i in range(BITS) if free >> i & 1]
    if n <= 2048 or len(open_bits) > 24:
        found = []
        for s in range(0, n, 512):
            near = np.bitwise_count(prints[s : s + 512, None] ^ prints[None, :]) <= radius
            i, j = np.nonzero(near)
            found.append((i + s, j))
    else:  # look up every neighbour over the few open bits
        flips = {0}
        for _ in range(radius):
            flips |= {f ^ b for f in flips for b in open_bits}
        found = []
        for flip in sorted(flips - {0}):
            other = prints ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(prints, other), n - 1)
            hit = np.flatnonzero(prints[at] == other)
            found.append((hit, at[hit]))
    left, right = (np.concatenate(x) for x in zip(*found))
    up = left < right
    left, right = left[up], right[up]
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _links(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Star edges from rows sorted by (table, value, block, fp); buckets may span batches."""
    rest: list[np.ndarray] = []

    def edges(table, value, block, fp):
        new = (table[1:] != table[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1])
        edge = np.flatnonzero(new) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(table)]])
        many = ends - starts > 1
        out = [np.zeros((2, 0), dtype=np.uint64)]
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            i, j = _bucket_links(fp[s:e], ~masks[table[s]] & (1 << BITS) - 1, radius)
            out.append(np.stack([fp[s + i], fp[s + j]]))
        a, b = np.concatenate(out, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        columns[3] = columns[3].view(np.uint64)
        if rest:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        last = np.flatnonzero(np.any([c != c[-1] for c in columns[:3]], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in columns]
        if cut:
            yield edges(*(c[:cut] for c in columns))
    if rest:
        yield edges(*rest)


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` between distinct ``fp`` that span every component."""
    refined = radius <= 3
    masks = covering_masks(radius, refined)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(signed)])
    )
    rows = prints.select(keys.alias("k"), "fp").select("k.t", "k.v", "fp")
    if refined:
        rows = rows.withColumn("block", F.lit(0).cast("bigint"))
    else:
        rows = paired_blocks(rows, ["t", "v"], "fp", BUCKET_ROWS)
    # fp is compared unsigned in Python: flipping the sign bit makes both orders agree.
    by_print = F.col("fp").bitwiseXOR(F.lit(-(2**63)))
    dealt = rows.select("t", "v", "block", "fp").repartition("t", "v", "block")
    return dealt.sortWithinPartitions("t", "v", "block", by_print).mapInArrow(
        partial(_links, masks=masks, radius=radius), "a bigint, b bigint"
    )


def grouped(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """``doc_id, key, version, fp, group`` (smallest linked print) and ``first`` (its key)."""
    plain = docs.select("doc_id", "text")
    prints = settle(fingerprints(plain, size))
    classes = settle(prints.groupBy("fp").agg(F.min(F.struct("key", "version")).alias("least")))
    found = connected_components(links(classes.select("fp"), radius))
    labelled = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")
    )
    first = labelled.groupBy("group").agg(F.min("least").alias("first"))
    return prints.join(labelled.drop("least").join(first, "group"), "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    component = F.col("first.key")
    return grouped(docs, size, radius).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(component != 2**63 - 1, component).alias("component_id"),
    )


def distinct_documents(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """One whole row of every group: the one with the smallest id (then text digest)."""
    winners = grouped(docs, size, radius).groupBy("group").agg(F.min("first").alias("w"))
    winners = winners.select(F.col("w.key").alias("key"), F.col("w.version").alias("version"))
    rows = docs.select(F.struct("*").alias("r")).withColumns(
        {"key": document_key(F.col("r.doc_id")), "version": F.xxhash64("r.text")}
    )
    kept = rows.join(winners, ["key", "version"], "left_semi").dropDuplicates(["key", "version"])
    return kept.select("r.*")
