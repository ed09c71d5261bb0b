"""Documents dealt into cells, and rolling hashes over their bytes.

Substring work asks questions of the whole corpus about places inside texts. Documents are
dealt by a hash of their id into cells of some megabytes; a cell asks each question once,
however many of its documents share the place, and gets its answers back by cell number. So
a passage that stands in a third of all documents costs one entry per cell. The dealt table
is one exchange that all phases of a query read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import document_key, parts

CELL_BYTES = 2 << 20
#: Text behind one bucket of questions; with cells it sets how many messages there are.
BUCKET_BYTES = 32 << 20
#: Partitions per bucket, so that hashes seldom put two into one, as long as there are few.
TASKS_PER_BUCKET, MAX_TASKS = 4, 1024
#: Positions hashed at a time, which bounds the arrays for very long texts.
SLAB = 1 << 17
BASE = 0x9E3779B97F4A7C15


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """``cell, doc_id, key, version, text`` and the number of buckets for questions.

    Both numbers follow the size of the texts, and are at least twice the shuffle
    partitions, so that small inputs use all tasks too.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = 2 * parts(docs.sparkSession)
    cells, buckets = (max(least, -(-size // n)) for n in (CELL_BYTES, BUCKET_BYTES))
    doc_id = F.col("doc_id").cast("bigint")
    plain = docs.select(
        doc_id.alias("doc_id"),
        document_key(doc_id).alias("key"),
        F.xxhash64("text").alias("version"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    cell = F.pmod(F.xxhash64("key", "version"), F.lit(cells)).alias("cell")
    return plain.select(cell, "doc_id", "key", "version", "text"), buckets


class Cell:
    """The texts of a cell in a fixed order as one byte array with document bounds."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("key", "ascending"), ("version", "ascending")])
        self.doc_id = table.column("doc_id").combine_chunks()
        self.key = table.column("key").to_numpy()
        text = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks])
        bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
        self.data = data[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(n, BASE, dtype=np.uint64)
    power[0] = 1
    inverse = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums mod 2**64, with a leading zero."""
    power, _ = powers(2 * SLAB)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of the summed values, the same wherever the span stands."""
    _, inverse = powers(2 * SLAB)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; slab by slab."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    _, inverse = powers(2 * SLAB)
    for s in range(0, n, SLAB):
        part = values[s : s + SLAB + size - 1]
        sums = prefix_sums(part)
        m = len(part) - size + 1
        out[s : s + m] = mix((sums[size:] - sums[:-size]) * inverse[:m])
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (the first on ties) in every window of ``width`` hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    for s in range(0, n, SLAB):
        part = hashes[s : s + SLAB + width - 1]
        best = (part & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        out[s : s + len(best)] = (best & np.uint64(0xFFFFFFFF)).astype(np.int64) + s
    return out


def valid_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which places of the concatenation start a run of ``size`` inside one document."""
    mask = np.zeros(max(int(bounds[-1]) - size + 1, 0), dtype=bool)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= size:
            mask[start : end - size + 1] = True
    return mask


def distinct_places(places: np.ndarray) -> np.ndarray:
    """The places of successive windows, once each; they never go back."""
    keep = np.ones(len(places), dtype=bool)
    keep[1:] = places[1:] != places[:-1]
    return places[keep]


def covered(marked: np.ndarray, size: int) -> np.ndarray:
    """Places inside a run of ``size`` that begins at a marked place."""
    begun = np.cumsum(marked, dtype=np.int32)
    begun[size:] -= begun[:-size].copy()
    return begun > 0


def pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(r) for r in raw], dtype=np.int64).tobytes()
    return zlib.compress(head + b"".join(raw), 1)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every hash, from its high half."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def seed_bucket(seeds: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every seed, in no order.

    Seeds are the smallest hashes of their windows, so their high halves are small ones: by
    them the first of 32 buckets would get more than half of all seeds.
    """
    return by_bucket(mix(seeds), buckets)


MESSAGE = "cell bigint, bucket bigint, body binary"


def messages(cell: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    bucket, body = zip(*rows) if rows else ((), ())
    return pa.table(
        {
            "cell": pa.array([cell] * len(rows), pa.int64()),
            "bucket": pa.array(bucket, pa.int64()),
            "body": pa.array(body, pa.binary()),
        }
    )


def meet(asked: DataFrame, buckets: int):
    """Messages grouped by bucket, on about a task per bucket.

    What a bucket costs is its merging, not its compressed bytes, by which adaptive execution
    would put most buckets into one task; so their partitions are given.
    """
    tasks = min(TASKS_PER_BUCKET * buckets, max(buckets, MAX_TASKS))
    return asked.repartition(tasks, "bucket").groupBy("bucket")


def runs_of(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of the runs of a sorted array."""
    if not len(keys):
        return []
    cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    return list(zip(keys[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist()))


def ask_seeds(cell: int, seeds: np.ndarray, buckets: int) -> pa.Table:
    """The distinct seed hashes of a cell, by bucket."""
    seeds = np.unique(seeds)
    bucket = seed_bucket(seeds, buckets)
    order = np.argsort(bucket, kind="stable")
    seeds = seeds[order]
    return messages(cell, [(b, pack(seeds[s:e])) for b, s, e in runs_of(bucket[order])])


def answer_seeds(keys: tuple, table: pa.Table) -> pa.Table:
    """For every cell, which of its seeds another cell has too."""
    cells = table.column("cell").to_numpy()
    bodies = [unpack(b, np.uint64)[0] for b in table.column("body").to_pylist()]
    every, times = np.unique(np.concatenate(bodies), return_counts=True)
    shared = every[times > 1]
    rows = []
    for cell, own in zip(cells.tolist(), bodies):
        both = np.intersect1d(own, shared, assume_unique=True)
        if len(both):
            rows.append((cell, pack(both)))
    return pa.table(
        {
            "cell": pa.array([c for c, _ in rows], pa.int64()),
            "bucket": pa.array([keys[0].as_py()] * len(rows), pa.int64()),
            "body": pa.array([b for _, b in rows], pa.binary()),
        }
    )


def shared_seeds(seed: np.ndarray, document: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which seed places have a seed that stands in two documents or more, here or elsewhere."""
    bodies = [unpack(b, np.uint64)[0] for b in answers.column("body").to_pylist()]
    elsewhere = np.concatenate([*bodies, np.zeros(0, dtype=np.uint64)])
    order = np.lexsort((document, seed))
    s, d = seed[order], document[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    here = np.zeros(len(seed), dtype=bool)
    if len(s):
        spread = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)
        here[order] = spread[group]
    return here | np.isin(seed, elsewhere)


