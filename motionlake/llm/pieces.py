"""SentencePiece byte-pair encoding and decoding with vectorised merge rounds.

A text is escaped (one leading space, spaces as U+2581) and cut where no piece of the
vocabulary can reach across: before a space that follows something else, and around
characters that stand in no longer piece. Merging is independent between such segments, so
the distinct segments of an Arrow batch are encoded once.

All their symbols lie in one flat array. A round looks up the rank of every adjacent pair,
takes the minimum per segment, merges its occurrences from the left at the same time, and
compacts the array, until no segment has a pair left. Merging one pair at a time from the
best score would give the same as long as the new piece cannot form a pair with a better
or equal score; pieces for which it could merge only at the leftmost place in a round.

Characters outside the vocabulary become byte pieces. The end id is appended.

Edge cases: a null or empty text is the end id alone and decodes to an empty text; text of
any length is one row and never cut; repeated rows are separate rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.session import ship_package

SPACE = "▁"
END = 2
NO_PAIR = np.iinfo(np.int32).max
#: Distinct segments remembered by a task between batches.
REMEMBERED = 200_000


class Vocabulary:
    """Pieces of a model as arrays: pair table, ranks, text of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not byte[i]]
        self.byte_ids = np.array([i for i in range(n) if byte[i]], dtype=np.int32)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        ids = {self.pieces[i]: i for i in normal}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        scores = np.array([model.get_score(i) for i in range(n)])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        rank = np.full(n, NO_PAIR, dtype=np.int32)
        rank[normal] = [order[scores[i]] for i in normal]
        keys, merged, best = [], [], np.full(n, NO_PAIR, dtype=np.int64)
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    merged.append(i)
                    best[left] = min(best[left], rank[i])
                    best[right] = min(best[right], rank[i])
        at = np.argsort(np.array(keys))
        self.size = n
        self.rank = rank
        #: Pieces after which a better or equal pair may appear.
        self.wary = best <= rank
        self._fill(np.array(keys, dtype=np.int64)[at], np.array(merged, dtype=np.int32)[at])
        if any(p[k] == SPACE != p[k - 1] for p in ids for k in range(1, len(p))):
            raise ValueError("a piece reaches over the start of a word")
        longer = {c for p in ids if len(p) > 1 for c in p}
        #: Line breaks are cut out as segments of their own when no piece joins them.
        self.lines_apart = "\n" not in longer
        self.raw = [b""] * n
        for i in normal:
            self.raw[i] = self.pieces[i].replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([value])
        self.raw_size = np.array([len(r) for r in self.raw])
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_size)])[:-1]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

    def _fill(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing table for pair lookups in a few array reads."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.table_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.table_piece = np.zeros(1 << self.bits, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.table_key[at[todo]] < 0
            spots, first = np.unique(at[todo][free], return_index=True)
            placed = todo[free][first]
            self.table_key[spots] = keys[placed]
            self.table_piece[spots] = merged[placed]
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of every pair, or -1. Ids below 0 never pair."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            found = self.table_key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.table_piece[at[hit]]
            open_ = ~hit & (found >= 0)
            todo, at = todo[open_], (at[open_] + 1) & (1 << self.bits) - 1
            if not len(todo):
                break
        return out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments and the number of ids of each."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4")
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        distinct, place = np.unique(codes, return_inverse=True)
        # A character that is no piece is -1 - its place; it takes no part in merging.
        first = np.array([self.chars.get(chr(c), -1 - j) for j, c in enumerate(distinct)], dtype=np.int32)
        symbol = first[place]
        symbol, owner = self._merge(symbol, owner, len(segments))
        unknown = np.flatnonzero(symbol < 0)
        if len(unknown):
            utf8 = [chr(c).encode() for c in distinct]
            spelled = [utf8[j] for j in (-1 - symbol[unknown]).tolist()]
            times = np.ones(len(symbol), dtype=np.int64)
            times[unknown] = [len(b) for b in spelled]
            start = (np.cumsum(times) - times)[unknown]
            owner = np.repeat(owner, times)
            symbol = np.repeat(symbol, times)
            spots = np.repeat(start, times[unknown]) + _steps(times[unknown])
            symbol[spots] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        return symbol, np.bincount(owner, minlength=len(segments))

    def _merge(self, symbol: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.arange(len(symbol))
        piece = self._pairs(symbol, owner)
        while len(symbol):
            rank = np.where(piece >= 0, self.rank[piece], NO_PAIR)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(owner)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            finished = best == NO_PAIR
            if finished.any():
                done.append((order[finished], symbol[finished], owner[finished]))
                go = ~finished
                symbol, owner, order, piece = symbol[go], owner[go], order[go], piece[go]
                rank, best = rank[go], best[go]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[self._leftmost(hit, owner, piece)]
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbol), dtype=bool)
            changed[hit] = True
            symbol, owner, order, piece, changed = symbol[keep], owner[keep], order[keep], piece[keep], changed[keep]
            # Only pairs that touch a new piece are looked up again.
            again = changed.copy()
            again[:-1] |= changed[1:]
            at = np.flatnonzero(again)
            piece[at] = self._pairs(symbol, owner, at)
        order, symbol, owner = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, dtype=np.int64),) * 3
        back = np.argsort(order, kind="stable")
        return symbol[back], owner[back]

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Merged piece of each symbol with the next one of its segment, or -1."""
        at = np.arange(len(symbol)) if at is None else at
        nxt = np.minimum(at + 1, len(symbol) - 1)
        out = self.merged(symbol[at], symbol[nxt])
        out[(owner[at] != owner[nxt]) | (nxt == at)] = -1
        return out

    def _leftmost(self, hit: np.ndarray, owner: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which of the best pairs merge now: from the left, without overlap."""
        step = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
        run = np.flatnonzero(step)
        nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate([run, [len(hit)]])))
        take = nth % 2 == 0
        wary = self.wary[piece[hit]]
        # Equal scores on different pieces, or a wary piece: only the first place.
        new = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
        starts = np.flatnonzero(new)
        mixed = np.minimum.reduceat(piece[hit], starts) != np.maximum.reduceat(piece[hit], starts)
        careful = np.logical_or.reduceat(wary, starts) | mixed
        take &= ~careful[np.cumsum(new) - 1] | new
        return take

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces in order; control ids have none."""
        sizes = self.raw_size[ids]
        return self.raw_bytes[np.repeat(self.raw_start[ids], sizes) + _steps(sizes)].tobytes()


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside every run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segments_of(text: str, lines_apart: bool) -> list[str]:
    """The text with its leading space, cut at the places no piece can cross."""
    escaped = " " + text.replace(SPACE, " ")
    cut = re.findall(" *[^ \n]+|\n| +", escaped) if lines_apart else re.findall(" *[^ ]+| +", escaped)
    return cut


def _coded(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    known: dict[str, int] = {}
    counts: list[int] = []
    spelled: list[bytes] = []
    plain: list[bytes] = []
    flat_ids: list[np.ndarray] = []
    for batch in batches:
        if len(known) > REMEMBERED:
            known.clear()
            for x in (counts, spelled, plain, flat_ids):
                x.clear()
        columns: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in _cut_batches(batch.column(1)):
            cut = [segments_of(t, vocab.lines_apart) if t else [] for t in text]
            fresh = list(dict.fromkeys(s for c in cut for s in c if s not in known))
            if fresh:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                ids, sizes = vocab.encode_segments([s.replace(" ", SPACE) for s in fresh])
                ends = np.cumsum(sizes)
                # Decode all at once: segments never share a character, so their bytes split.
                raw = vocab.decode(ids)
                raw_ends = np.concatenate([[0], np.cumsum(vocab.raw_size[ids])])[ends].tolist()
                words = list(map(str, ids.tolist()))
                begin = raw_begin = 0
                for end, raw_end in zip(ends.tolist(), raw_ends):
                    spelled.append(" ".join(words[begin:end]).encode())
                    plain.append(raw[raw_begin:raw_end])
                    begin, raw_begin = end, raw_end
                counts.extend(sizes.tolist())
                if full:
                    flat_ids.extend(np.split(ids, ends[:-1]))
            for c in cut:
                at = [known[s] for s in c]
                columns["n_tokens"].append(sum([counts[i] for i in at]) + 1)
                spell = [spelled[i] for i in at]
                spell.append(str(END).encode())
                columns["ids_sha256"].append(hashlib.sha256(b" ".join(spell)).hexdigest())
                decoded = b"".join([plain[i] for i in at])[1:]
                columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if full:
                    columns["ids"].append(np.concatenate([*(flat_ids[i] for i in at), [END]]).astype(np.int32))
                    columns["decoded"].append(decoded.decode())
        arrays = [batch.column(0), pa.array(columns["n_tokens"], pa.int64()), pa.array(columns["ids_sha256"], pa.string()), pa.array(columns["decoded_sha256"], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            arrays += [pa.array(columns["ids"], pa.list_(pa.int32())), pa.array(columns["decoded"], pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _cut_batches(column: pa.Array, size: int = 1 << 22) -> Iterator[list[str | None]]:
    """Texts in lists of some 4 MB, which bounds the arrays of a merge round."""
    part, held = [], 0
    for value in column:
        text = value.as_py()
        part.append(text)
        held += len(text or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def coded_documents(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """Per document: token count and digests; with ``full`` also ``ids`` and ``decoded``.

    ``path`` names a sentencepiece BPE model with byte fallback on the executors.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if full:
        schema += ", ids array<int>, decoded string"
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return plain.mapInArrow(partial(_coded, path=path, full=full), schema)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
