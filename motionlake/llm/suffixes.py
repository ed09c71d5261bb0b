"""Substring deduplication of bytes by a common-prefix-aware distributed merge sort.

Which suffixes are sorted: every string of ``size`` bytes picks the smallest hash of its
``SEED_BYTES``-byte grams, so equal strings pick the same gram at the same offset. Only
suffixes that start at such a gram can decide anything, and of those only the ones whose
gram stands in two documents or more (a first exchange of distinct gram hashes tells which).

Sorting: every cell sorts its suffixes, cut at ``size`` bytes and followed by the bytes
before them in reverse, and keeps one of equal ones with its smallest document. The sorted
runs are front coded (length of the prefix shared with the entry before, then the rest) and
exchanged by gram. A loser tree merges the runs of all cells: each player carries the
length of the prefix it shares with the last winner, the longer one wins unseen, and only
on a draw are bytes compared, from that length on. The merge returns the shared prefix
lengths of neighbours, from which the groups of one gram are read.

Deciding: inside a group, each of the strings of ``size`` bytes around the gram is held
against the smallest document that has it. Answers go back per cell as a context hash with
one bit for each string; the cell marks the bytes, also for the documents of its own whose
string stands in a smaller one beside it.

Strings are told apart by 64-bit hashes after the sort: n distinct ones meet by chance with a
probability of n**2 / 2**65.

Edge cases: null and empty texts have no bytes; rows with the same id never remove bytes
from each other; a null id counts as the largest; texts shorter than ``size`` stay whole;
NUL bytes and cut characters are ordinary bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motionlake.llm import cells as C
from motionlake.session import ship_package

SIZE = 50
SEED_BYTES = 24
#: Stands for bytes outside the document; not a byte of UTF-8, as NUL's stand-in.
OUTSIDE, NUL = 0xFF, 0xF8
ROWS = 1 << 12


def _seeds(texts: C.Cell, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places of selected grams, their hashes and their documents."""
    valid = C.valid_starts(texts.bounds, size)
    if not valid.any():
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    grams = C.gram_hashes(texts.data, SEED_BYTES)
    place = C.distinct_places(C.winnow(grams, size - SEED_BYTES + 1)[valid])
    return place, grams[place], np.searchsorted(texts.bounds, place, side="right") - 1


def _contexts(texts: C.Cell, place: np.ndarray, document: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` bytes from the place on, then the bytes before it, nearest first."""
    back = size - SEED_BYTES
    offsets = np.concatenate([np.arange(size), -1 - np.arange(back)])
    at = place[:, None] + offsets
    low, high = texts.bounds[document][:, None], texts.bounds[document + 1][:, None]
    inside = (at >= low) & (at < high)
    rows = texts.data[np.where(inside, at, 0)]
    rows[rows == 0] = NUL
    rows[~inside] = OUTSIDE
    return rows


def _hashes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    base = np.uint64(C.BASE)
    for column in rows.T:
        out = out * base + column + np.uint64(1)
    return C.mix(out)


def _ask(cell: int, table: pa.Table, buckets: int, size: int) -> pa.Table:
    _, seed, _ = _seeds(C.Cell(table), size)
    return C.ask_seeds(cell, seed, buckets)


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix each sorted row shares with the row before it."""
    out = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        first = differs.argmax(axis=1)
        first[~differs.any(axis=1)] = rows.shape[1]
        out[1:] = first
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths and the bytes after them, of sorted rows of one width."""
    shared = shared_prefixes(rows)
    rest = np.arange(rows.shape[1]) >= shared[:, None]
    return shared, rows[rest].tobytes()


def _runs(cell: int, table: pa.Table, answers: pa.Table, buckets: int, size: int) -> pa.Table:
    """Front-coded sorted runs of the suffixes at shared grams, one per bucket."""
    if not table.num_rows:
        return C.messages(cell, [])
    texts = C.Cell(table)
    place, seed, document = _seeds(texts, size)
    near = np.flatnonzero(C.shared_seeds(seed, document, answers)) if len(place) else place
    if not len(near):
        return C.messages(cell, [])
    bucket = C.seed_bucket(seed[near], buckets)
    order = np.argsort(bucket, kind="stable")
    out = []
    for b, s, e in C.runs_of(bucket[order]):
        own = near[order[s:e]]
        rows = np.concatenate(
            [_contexts(texts, place[own[i : i + ROWS]], document[own[i : i + ROWS]], size) for i in range(0, len(own), ROWS)]
        )
        # No row holds a NUL, so fixed-width strings compare like the bytes themselves.
        text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
        _, first = np.unique(text, return_index=True)
        rows = rows[first]  # the first of equal ones has the smallest document key
        out.append((b, C.pack(*front_code(rows), texts.key[document[own[first]]])))
    return C.messages(cell, out)


def read_run(shared: list[int], rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """Entries of a front-coded run as (prefix shared with the entry before, entry)."""
    entry, at = b"", 0
    for n in shared:
        end = at + width - n
        entry = entry[:n] + rest[at:end]
        at = end
        yield n, entry


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Loser-tree merge of sorted runs: (run, prefix shared with the last winner, entry).

    A node keeps the loser of its match. Players compare the prefix lengths they share
    with the last winner; bytes are compared only on a draw and only after that prefix.
    """
    k = len(runs)
    leaves = 1
    while leaves < k:
        leaves *= 2
    done = (-1, None)
    now = [next(r, done) for r in runs] + [done] * (leaves - k)
    length = [n for n, _ in now]
    entry: list[bytes | None] = [x for _, x in now]
    loser = [0] * leaves

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes its prefix shared with the winner."""
        x, y = entry[a], entry[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        m, n = length[a], length[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        if x == y:
            length[b] = len(x)
            return a, b
        gap = int.from_bytes(x[m:]) ^ int.from_bytes(y[m:])  # finds the first byte that differs in one step
        m = len(x) - (gap.bit_length() + 7) // 8
        if x[m] < y[m]:
            length[b] = m
            return a, b
        length[a] = m
        return b, a

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        winner, loser[node] = match(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while entry[winner] is not None:
        yield winner, length[winner], entry[winner]
        length[winner], entry[winner] = next(runs[winner], done) if winner < k else done
        node = (winner + leaves) // 2
        player = winner
        while node:
            player, loser[node] = match(player, loser[node])
            node //= 2
        winner = player


#: Merged entries decided at a time; a chunk ends where a group of one gram ends.
CHUNK = 1 << 14


def _decide(keys: tuple, table: pa.Table, size: int) -> pa.Table:
    """Merge the runs of a bucket and answer, per cell, which strings stand earlier.

    The merge is a stream: beside the front-coded runs only one chunk is held.
    """
    width = 2 * size - SEED_BYTES
    cells = table.column("cell").to_pylist()
    runs, run_keys = [], []
    for body in table.column("body").to_pylist():
        shared, rest, key = C.unpack(body, np.uint8, np.uint8, np.int64)
        runs.append(read_run(shared.tolist(), rest.tobytes(), width))
        run_keys.append(key.copy())  # lets go of the unpacked body
    read = np.zeros(len(runs), dtype=np.int64)
    answers: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in runs]

    def flush():
        order = np.argsort(who := np.array(chunk_who), kind="stable")
        count = np.bincount(who, minlength=len(runs))
        # A run's entries leave the tree in their own order, so its keys follow.
        key = np.empty(len(who), dtype=np.int64)
        key[order] = np.concatenate([run_keys[r][read[r] : read[r] + n] for r, n in enumerate(count.tolist())])
        read[:] += count
        late, hashed, mask = _chunk(np.array(chunk_prefix), key, chunk_entries, size)
        by_run = np.argsort(who[late], kind="stable")
        for r, s, e in C.runs_of(who[late][by_run]):
            answers[r].append((hashed[by_run[s:e]], mask[by_run[s:e]]))

    chunk_who: list[int] = []
    chunk_prefix: list[int] = []
    chunk_entries: list[bytes] = []
    for run, shared, entry in merge_runs(runs):
        if shared < SEED_BYTES and len(chunk_who) >= CHUNK:
            flush()
            chunk_who, chunk_prefix, chunk_entries = [], [], []
        chunk_who.append(run)
        chunk_prefix.append(shared)
        chunk_entries.append(entry)
    flush()
    out = [(c, C.pack(*(np.concatenate(x) for x in zip(*a)))) for c, a in zip(cells, answers) if a]
    return pa.table(
        {
            "cell": pa.array([c for c, _ in out], pa.int64()),
            "bucket": pa.array([keys[0].as_py()] * len(out), pa.int64()),
            "body": pa.array([b for _, b in out], pa.binary()),
        }
    )


def _chunk(prefix: np.ndarray, key: np.ndarray, entries: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of merged neighbours: which have earlier strings, their context hashes and masks."""
    back = size - SEED_BYTES
    width = size + back
    rows = np.frombuffer(b"".join(entries), dtype=np.uint8).reshape(-1, width)
    prefix[:1] = 0
    new_context = prefix < width
    context = np.cumsum(new_context) - 1
    least = np.minimum.reduceat(key, np.flatnonzero(new_context))
    new_group = (prefix < SEED_BYTES)[new_context]
    new_group[:1] = True
    group = np.cumsum(new_group) - 1
    distinct = rows[new_context]
    # The string that starts j bytes before the gram: j bytes before, size - j from it on.
    ahead = size - np.argmax(distinct[:, :size][:, ::-1] != OUTSIDE, axis=1)
    behind = distinct[:, size:] == OUTSIDE
    before = np.where(behind.any(axis=1), behind.argmax(axis=1), back)
    mask = np.zeros(len(rows), dtype=np.uint32)
    alone = np.bincount(group)[group] == 1
    many = np.flatnonzero(~alone)
    ordered = np.concatenate([distinct[many][:, size:][:, ::-1], distinct[many][:, :size]], axis=1)
    sums = np.zeros((len(many), width + 1), dtype=np.uint64)
    power, inverse = C.powers(2 * C.SLAB)
    np.cumsum((ordered.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, out=sums[:, 1:])
    salt = C.mix(group[many].astype(np.uint64) + np.uint64(1))
    for j in range(back + 1):
        fits = (before >= j) & (ahead >= size - j)
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        first[alone] = least[alone]
        at = np.flatnonzero(fits[many])
        if len(at):
            s = back - j
            h = (sums[at, s + size] - sums[at, s]) * inverse[s] ^ salt[at]
            order = np.argsort(h, kind="stable")
            start = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            low = np.minimum.reduceat(least[many[at]][order], np.flatnonzero(start))
            first[many[at[order]]] = low[np.cumsum(start) - 1]
        hit = fits[context] & (key > first[context])
        mask[hit] |= np.uint32(1 << j)
    late = np.flatnonzero(mask)
    return late, _hashes(rows[late]), mask[late]


def _marked_starts(texts: C.Cell, answers: pa.Table, size: int) -> np.ndarray:
    """Marks where a string of the cell starts that also starts in a smaller document."""
    marked = np.zeros(len(texts.data), dtype=bool)
    place, _, document = _seeds(texts, size)
    if not len(place):
        return marked
    hashed = np.empty(len(place), dtype=np.uint64)
    for s in range(0, len(place), ROWS):
        hashed[s : s + ROWS] = _hashes(_contexts(texts, place[s : s + ROWS], document[s : s + ROWS], size))
    ahead = texts.bounds[document + 1] - place
    before = place - texts.bounds[document]
    _, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    key = texts.key[document]
    everywhere = key > key[first][back]
    bodies = [C.unpack(b, np.uint64, np.uint32) for b in answers.column("body").to_pylist()]
    late = np.concatenate([*(b[0] for b in bodies), np.zeros(0, dtype=np.uint64)])
    bits = np.concatenate([*(b[1] for b in bodies), np.zeros(0, dtype=np.uint32)])
    order = np.argsort(late)
    late, bits = late[order], bits[order]
    mask = np.zeros(len(place), dtype=np.uint32)
    if len(late):
        at = np.minimum(np.searchsorted(late, hashed), len(late) - 1)
        mask = np.where(late[at] == hashed, bits[at], 0).astype(np.uint32)
    some = np.flatnonzero(everywhere | (mask != 0))
    place, mask, everywhere, before, ahead = (x[some] for x in (place, mask, everywhere, before, ahead))
    mask[everywhere] = np.uint32(0xFFFFFFFF)
    for j in range(size - SEED_BYTES + 1):
        hit = (mask >> np.uint32(j) & np.uint32(1)).astype(bool) & (before >= j) & (ahead >= size - j)
        marked[place[hit] - j] = True
    return marked


def _cut(table: pa.Table, answers: pa.Table, size: int) -> pa.Table:
    """The documents of a cell without their repeated bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    if not table.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    texts = C.Cell(table)
    gone = C.covered(_marked_starts(texts, answers, size), size)
    rows = []
    for s, e in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
        lost, data = gone[s:e], texts.data[s:e]
        n = int(lost.sum())
        spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()) if n else 0
        kept = (data[~lost] if n else data).tobytes()
        rows.append((e - s, n, spans, hashlib.sha256(kept).hexdigest(), kept))
    return pa.table([texts.doc_id, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], names=names)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document."""
    ship_package(docs.sparkSession)
    dealt, buckets = C.deal(docs)
    by_cell = dealt.groupBy("cell")

    def ask(keys, table):
        return _ask(keys[0].as_py(), table, buckets, size)

    def runs(keys, table, answers):
        return _runs(keys[0].as_py(), table, answers, buckets, size)

    def decide(keys, table):
        return _decide(keys, table, size)

    def cut(keys, table, answers):
        return _cut(table, answers, size)

    answers = C.meet(by_cell.applyInArrow(ask, C.MESSAGE), buckets).applyInArrow(C.answer_seeds, C.MESSAGE)
    sorted_runs = by_cell.cogroup(answers.groupBy("cell")).applyInArrow(runs, C.MESSAGE)
    late = C.meet(sorted_runs, buckets).applyInArrow(decide, C.MESSAGE)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return by_cell.cogroup(late.groupBy("cell")).applyInArrow(cut, schema)
