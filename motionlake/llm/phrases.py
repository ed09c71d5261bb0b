"""Substring deduplication of word sequences: seed and extend.

Seeds: every window of ``size`` words picks the smallest hash of its ``SEED_WORDS``-word
grams (winnowing), so equal windows pick the same gram at the same offset. Documents are
joined on these anchors: a cell asks about its distinct seeds and learns which stand in
other documents too. Extension: from each shared seed the match is extended word by word
both ways over all windows that hold it, by comparing window digests with the earliest
document that has them; overlapping windows of a document merge to maximal repeats. A word
is removed when some window over it also starts in a document with a smaller id.

Digests have 64 bits: n distinct windows meet by chance with a probability of n**2 / 2**65.

Edge cases: null and empty texts have no words; rows with the same id never remove words
from each other; a null id counts as the largest; texts shorter than a window are kept
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motionlake.llm import cells as C
from motionlake.session import ship_package

WINDOW = 13
SEED_WORDS = 5
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Word hashes of a cell with the word bounds of its documents."""

    def __init__(self, cell: C.Cell):
        data, bounds = cell.data, cell.bounds
        gap = SPACE[data]
        first = ~gap
        first[1:] &= gap[:-1]
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
        first[inner] = ~gap[inner]
        self.start = np.flatnonzero(first)
        # A word ends at the next gap or document bound.
        stop = np.unique(np.concatenate([np.flatnonzero(gap), bounds[1:]]))
        self.end = stop[np.searchsorted(stop, self.start, side="right")] if len(self.start) else self.start
        self.bounds = np.searchsorted(self.start, bounds)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            base = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, base + C.SLAB, side="right")))
            span = data[base : self.end[upto - 1]]
            if len(span) > C.SLAB:  # one enormous word
                digest = hashlib.blake2b(span.tobytes(), digest_size=8).digest()
                self.hash[at] = np.frombuffer(digest, dtype=np.uint64)[0]
            else:
                sums = C.prefix_sums(span)
                self.hash[at:upto] = C.span_hashes(sums, self.start[at:upto] - base, self.end[at:upto] - base)
            at = upto


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside documents and their digests."""
    starts = np.flatnonzero(C.valid_starts(words.bounds, size))
    return starts, C.gram_hashes(words.hash, size)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)


def _seeds(words: Words, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window the hash of its seed and the document it lies in."""
    grams = C.gram_hashes(words.hash, SEED_WORDS)
    place = C.winnow(grams, size - SEED_WORDS + 1)[starts]
    return grams[place], np.searchsorted(words.bounds, starts, side="right") - 1


def _ask(cell: int, table: pa.Table, buckets: int, size: int) -> pa.Table:
    words = Words(C.Cell(table))
    starts, _ = _windows(words, size)
    if not len(starts):
        return C.messages(cell, [])
    return C.ask_seeds(cell, _seeds(words, starts, size)[0], buckets)


def _offer(cell: int, table: pa.Table, answers: pa.Table, buckets: int, size: int) -> pa.Table:
    """Digests of the windows around shared seeds, with their smallest key in the cell."""
    if not table.num_rows:
        return C.messages(cell, [])
    texts = C.Cell(table)
    words = Words(texts)
    starts, digest = _windows(words, size)
    if not len(starts):
        return C.messages(cell, [])
    seed, document = _seeds(words, starts, size)
    near = C.shared_seeds(seed, document, answers)
    # Documents are in key order, so the first place of a digest has the smallest key.
    digest, first = np.unique(digest[near], return_index=True)
    key = texts.key[document[near][first]]
    bucket = C.by_bucket(digest, buckets)
    rows = []
    for b, s, e in C.runs_of(bucket):
        order = np.lexsort((digest[s:e], key[s:e]))
        own, times = np.unique(key[s:e], return_counts=True)
        rows.append((b, C.pack(own, times.astype(np.int32), digest[s:e][order])))
    return C.messages(cell, rows)


def _earlier(keys: tuple, table: pa.Table) -> pa.Table:
    """For every cell, the digests that a smaller key of another cell has."""
    who, key, digest = [], [], []
    cells = table.column("cell").to_pylist()
    for i, body in enumerate(table.column("body").to_pylist()):
        own, times, d = C.unpack(body, np.int64, np.int32, np.uint64)
        who.append(np.full(len(d), i))
        key.append(np.repeat(own, times))
        digest.append(d)
    who, key, digest = np.concatenate(who), np.concatenate(key), np.concatenate(digest)
    order = np.lexsort((key, digest))
    digest, key, who = digest[order], key[order], who[order]
    first = np.concatenate([[True], digest[1:] != digest[:-1]])
    least = key[first][np.cumsum(first) - 1]
    late = np.flatnonzero(key > least)
    by_cell = late[np.argsort(who[late], kind="stable")]
    rows = [(cells[i], C.pack(digest[by_cell[s:e]])) for i, s, e in C.runs_of(who[by_cell])]
    return pa.table(
        {
            "cell": pa.array([c for c, _ in rows], pa.int64()),
            "bucket": pa.array([keys[0].as_py()] * len(rows), pa.int64()),
            "body": pa.array([b for _, b in rows], pa.binary()),
        }
    )


def _cut(table: pa.Table, answers: pa.Table, size: int) -> pa.Table:
    """The documents of a cell without their repeated words."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if not table.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    texts = C.Cell(table)
    words = Words(texts)
    starts, digest = _windows(words, size)
    total = len(words.start)
    gone = np.zeros(total, dtype=bool)
    if len(starts):
        late = np.concatenate([*(C.unpack(b, np.uint64)[0] for b in answers.column("body").to_pylist()), np.zeros(0, dtype=np.uint64)])
        key = texts.key[np.searchsorted(words.bounds, starts, side="right") - 1]
        _, first, back = np.unique(digest, return_index=True, return_inverse=True)
        hit = key > key[first][back]
        if len(late):
            hit |= np.isin(digest, late)
        marked = np.zeros(total, dtype=bool)
        marked[starts[hit]] = True
        gone = C.covered(marked, size)
    raw = texts.data.tobytes()
    rows = []
    removed = np.concatenate([[0], np.cumsum(gone)])
    for i in range(len(texts.key)):
        s, e = int(words.bounds[i]), int(words.bounds[i + 1])
        n = int(removed[e] - removed[s])
        if n:
            stay = s + np.flatnonzero(~gone[s:e])
            kept = b" ".join([raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist())])
        else:
            kept = b" ".join(raw[texts.bounds[i] : texts.bounds[i + 1]].split())
        rows.append((e - s, n, hashlib.sha256(kept).hexdigest(), kept.decode()))
    columns = zip(*rows)
    return pa.table([texts.doc_id, *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names)


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every document."""
    ship_package(docs.sparkSession)
    dealt, buckets = C.deal(docs)
    by_cell = dealt.groupBy("cell")

    def ask(keys, table):
        return _ask(keys[0].as_py(), table, buckets, size)

    def offer(keys, table, answers):
        return _offer(keys[0].as_py(), table, answers, buckets, size)

    def cut(keys, table, answers):
        return _cut(table, answers, size)

    answers = by_cell.applyInArrow(ask, C.MESSAGE).groupBy("bucket").applyInArrow(C.answer_seeds, C.MESSAGE)
    offers = by_cell.cogroup(answers.groupBy("cell")).applyInArrow(offer, C.MESSAGE)
    late = offers.groupBy("bucket").applyInArrow(_earlier, C.MESSAGE)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    return by_cell.cogroup(late.groupBy("cell")).applyInArrow(cut, schema)
