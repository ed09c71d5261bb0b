"""Near duplicates by the exact Jaccard similarity of word shingles.

Candidates: ``BANDS`` keys of ``ROWS`` minimum hashes each. A pair of similarity s shares a
key with probability ``1 - (1 - s**ROWS)**BANDS``: all but about 3 in a million at 0.8, and
fewer above. SimHash groups, where given, come first: every member is a candidate with the
least node of its group, and what they link is not asked again. No candidate counts by its
key or group alone: the sets of 64-bit shingle hashes of both texts are compared, and a link
is a similarity of ``LEAST`` or more.

A bucket never yields its pairs. In ``HUB_ROUNDS`` rounds every node is compared with one other
node, the smallest least member of its buckets that is not yet of its component; a hub meets
its partners in groups of ``GROUP``, so its set travels once per group. Buckets that still hold
several components are cut into blocks, and all pairs of a block across components are compared
inside it: only edges that span the links found there leave it. Members of a bucket's largest
component are not compared with one another again.

Edge cases: nodes are distinct word sequences, so texts that differ in case or spacing only
are one node; null and empty texts are one node too; a text of fewer words than a shingle is
its own single shingle; repeated rows are one document; a null id counts as the largest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import document_key
from motionlake.llm.components import connected_components
from motionlake.session import settle, ship_package

LEAST = 0.8
BANDS, ROWS = 32, 5
SEED = 42
HUB_ROUNDS = 2
#: Shingles hashed at a time, and partners of a hub that are compared at a time.
STEP = 512
GROUP = 256
#: Members and shingles of a chunk of a bucket; a block holds two chunks.
CHUNK_ROWS = 256
CHUNK_SHINGLES = 2**20

_RNG = np.random.default_rng(SEED)
FLIPS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = _RNG.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    if len(words) <= size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[k:] for k in range(size))))


def shingle_set(text: str | None, size: int) -> set[bytes]:
    return set(_shingles(_words(text), size))


def minima(words: list[bytes], size: int) -> np.ndarray:
    """Minimum of each of the hash functions over the shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    hashes = np.fromiter((digest(s, SEED) for s in _shingles(words, size)), dtype=np.uint64)
    for start in range(0, len(hashes), STEP):
        mixed = (hashes[start : start + STEP, None] ^ FLIPS) * FACTORS
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        nodes, bands, sizes = [], [], []
        for text in batch.column(2):
            words = _words(text.as_py())
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            least = minima(words, size)
            keys = (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64)
            bands.append((keys ^ keys >> np.uint64(29)).view(np.int64))
            sizes.append(max(1, len(words) - size + 1))
        arrays = [
            batch.column(0),
            batch.column(1),
            pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
            pa.array(bands, pa.list_(pa.int64())),
            pa.array(sizes, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "version", "node", "bands", "size"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(document_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("version"), "text")


def _hash_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) with the sorted distinct hashes of the shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        sets = []
        for text in batch.column(1):
            hashes = np.fromiter((digest(x, SEED) for x in _shingles(_words(text.as_py()), size)), dtype=np.uint64)
            sets.append(np.unique(hashes).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def _with_hub(hubs: pa.Table, members: pa.Table) -> pa.Table:
    """The members of a group that are similar to their hub."""
    keep = np.zeros(members.num_rows, dtype=bool)
    if hubs.num_rows:
        hub = np.sort(np.asarray(hubs.column("hub").combine_chunks()[0].values))
        for i, entry in enumerate(members.column("set")):
            other = np.asarray(entry.values)
            at = np.minimum(np.searchsorted(hub, other), len(hub) - 1)
            both = int((hub[at] == other).sum())
            keep[i] = both >= LEAST * (len(hub) + len(other) - both)
    return members.select(["a", "node"]).rename_columns(["a", "b"]).filter(pa.array(keep))


def _to_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``, settled; a hub's partners are dealt into groups."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("k"))
    dealt = settle(pairs.join(sizes, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), "k").alias("g")))
    members = dealt.join(sets, "node")
    hubs = dealt.select(F.col("a").alias("h"), F.col("g").alias("hg")).distinct()
    hubs = hubs.join(sets.select(F.col("node").alias("h"), F.col("set").alias("hub")), "h")
    return settle(hubs.groupBy("h", "hg").cogroup(members.groupBy("a", "g")).applyInArrow(_with_hub, "a bigint, b bigint"))


def _spanning(node: np.ndarray, label: np.ndarray, chunk: np.ndarray, block: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of one block: pairs of its two chunks, or within its one."""
    n = len(node)
    size = np.array([len(x) for x in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((n, n), dtype=np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1, 8192):
            s, e = np.searchsorted(column, [start, start + 8192])
            held = np.zeros((n, 8192), dtype=np.float32)
            held[owner[s:e], column[s:e] - start] = 1
            both += held @ held.T
    near = both >= LEAST * (size[:, None] + size[None, :] - both)
    near &= label[:, None] != label[None, :]
    low, high = block >> 20, block & (1 << 20) - 1
    if low != high:
        near &= chunk[:, None] != chunk[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    root = np.arange(n)
    _, root = np.unique(label, return_inverse=True)
    least = np.full(root.max() + 1, n)
    np.minimum.at(least, root, np.arange(n))
    root = least[root]
    edges = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = root[x], root[y]
        if a != b:
            edges.append((node[x], node[y]))
            root[root == max(a, b)] = min(a, b)
    pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of blocks, from rows sorted by bucket and block; a block may span batches."""
    keys = ["t", "v", "block"]

    def emit(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).to_numpy() for c in (*keys, "node", "label", "chunk")}
        sets = [np.asarray(x.values) for x in rows.column("set")]
        new = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), rows.num_rows]
        found = [
            _spanning(*(columns[c][s:e] for c in ("node", "label", "chunk")), int(columns["block"][s]), sets[s:e])
            for s, e in zip(cuts, cuts[1:])
            if (columns["label"][s:e] != columns["label"][s]).any()
        ]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        last = np.all([c == c[-1] for c in (rows.column(k).to_numpy() for k in keys)], axis=0)
        cut = rows.num_rows - int(last.sum())
        if cut:
            yield emit(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield emit(rest)


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of mixed buckets (t, v, node, label, size) with their blocks.

    The largest component of a bucket is cut into chunks of its own and all others into
    chunks of theirs; blocks are the pairs of chunks that are not both of the largest.
    """
    per_label = members.groupBy("t", "v", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    total = per_label.groupBy("t", "v").agg(
        F.max(F.struct("n", "label", "w")).alias("big"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("labels")
    ).where("labels > 1")

    def chunks(n, w):
        return F.greatest(F.ceil(n / CHUNK_ROWS), F.ceil(w / CHUNK_SHINGLES), F.lit(1)).cast("int")

    cut = total.select(
        "t", "v", F.col("big.label").alias("major"), chunks(F.col("big.n"), F.col("big.w")).alias("p"),
        chunks(F.col("n") - F.col("big.n"), F.col("w") - F.col("big.w")).alias("q"),
    )
    is_major = F.col("label") == F.col("major")
    place = F.xxhash64("node")
    rows = members.join(cut, ["t", "v"]).withColumn("chunk", F.when(is_major, F.pmod(place, "p")).otherwise(F.col("p") + F.pmod(place, "q")).cast("int"))
    other = F.explode(F.sequence(F.when(is_major, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1))
    rows = rows.withColumn("other", other)
    block = F.least("chunk", "other").cast("bigint") * 2**20 + F.greatest("chunk", "other")
    return rows.select("t", "v", block.alias("block"), "node", "label", "chunk")


def _close(classes: DataFrame, similar: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least node of a SimHash group and every other one."""
    groups = similar.groupBy("key", "version").agg(F.first("group").alias("group"))
    nodes = classes.select("node", "least.key", "least.version").join(groups, ["key", "version"])
    hubs = nodes.groupBy("group").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    return nodes.join(hubs, "group").where("node <> a").select("a", F.col("node").alias("b"))


def links(classes: DataFrame, docs: DataFrame, size: int, similar: DataFrame | None = None) -> DataFrame:
    """Edges ``a, b`` between distinct nodes that span every component."""
    rows = classes.select(F.posexplode("bands").alias("t", "v"), "node", "size")
    shared = rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = settle(rows.join(shared, ["t", "v"]).withColumn("label", F.col("node")))
    close = None if similar is None else settle(_close(classes, similar))
    compared = buckets.select("node")
    if close is not None:
        compared = compared.unionByName(close.select(F.explode(F.array("a", "b")).alias("node")))
    needed = classes.join(compared.distinct(), "node", "left_semi").select("node", "least.key", "least.version")
    texts = _keyed(docs).join(needed, ["key", "version"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = settle(texts.mapInArrow(partial(_hash_sets, size=size), "node bigint, set array<bigint>"))
    edges = None
    for given in [*([] if close is None else [close]), *[None] * HUB_ROUNDS]:
        if given is not None:
            pairs = given
        else:
            hubs = buckets.groupBy("t", "v").agg(F.min(F.struct("label", "node")).alias("hub"))
            asked = buckets.join(hubs, ["t", "v"]).where("label <> hub.label")
            pairs = asked.groupBy(F.col("node").alias("b")).agg(F.min("hub.node").alias("a"))
        found = _to_hubs(pairs, sets)
        edges = found if edges is None else edges.unionByName(found)
        labels = connected_components(edges).withColumnRenamed("component", "to")
        named = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        mixed = named.groupBy("t", "v").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        buckets = settle(named.join(mixed.select("t", "v"), ["t", "v"], "left_semi"))
    full = _blocks(buckets).join(sets, "node")
    by = ["t", "v", "block"]
    across = full.repartition(*by).sortWithinPartitions(*by).mapInArrow(_in_blocks, "a bigint, b bigint")
    return edges.unionByName(across)


def distinct_documents(docs: DataFrame, size: int, similar: DataFrame | None = None) -> DataFrame:
    """One whole row of every group: the one with the smallest id (then text digest).

    ``similar`` (key, version, group) are SimHash groups of the same rows, as
    ``simhash.grouped`` gives them.
    """
    ship_package(docs.sparkSession)
    schema = "key bigint, version bigint, node bigint, bands array<bigint>, size bigint"
    prints = _keyed(docs).mapInArrow(partial(_prints, size=size), schema)
    classes = settle(
        prints.groupBy("node").agg(
            F.min(F.struct("key", "version")).alias("least"), F.first("bands").alias("bands"), F.first("size").alias("size")
        )
    )
    found = connected_components(links(classes, docs, size, similar))
    group = F.coalesce("component", classes.node)
    winners = classes.join(found, classes.node == found.node, "left").groupBy(group.alias("group")).agg(F.min("least").alias("w"))
    winners = winners.select(F.col("w.key").alias("key"), F.col("w.version").alias("version"))
    rows = docs.select(F.struct("*").alias("r")).withColumns(
        {"key": document_key(F.col("r.doc_id")), "version": F.xxhash64("r.text")}
    )
    kept = rows.join(winners, ["key", "version"], "left_semi").dropDuplicates(["key", "version"])
    return kept.select("r.*")
