"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then scoring.

Channel: a disguised word is a letter sequence whose characters were swapped for leetspeak,
masked, repeated, or set apart by spaces and marks. Each character of a suspicious token
opens the letters it may stand for (and, for marks and repeated letters, its deletion);
Viterbi search over this lattice under a character trigram model of the corpus restores the
likeliest word. Tokens of plain letters are their own restoration, and every distinct
token is decoded once per task.

Scoring: features are the restored word and its prefixes of 4 to 6 letters, hashed to
``2**FEATURE_BITS`` places, which bounds the model. Each has a shrunk toxic rate from a
sample of at most ``SAMPLE`` labelled training rows, in which near copies with
the same label (equal ``ALIKE`` minimum hashes of word pairs, twice) count once. The score of a text is the noisy-or of its few strongest
distinct features, so a single insult in a long text is enough and common words add
nothing. If more than ``MIN_RATE / 2`` of the labels are toxic, counts are weighed down to that
share: a toxic row counts as much as its evidence against chance, log(1 / share), and clean
rows keep the odds of a chance word at that of the share. Scores refer to the lower share. The character model is counted over all documents.

Only labels of rows whose ``crc32(doc_id) mod 3`` is not 1 are read; doc_id, source, lang and
labels never enter a score.

Edge cases: null and empty texts get the score of a text without features; a row without
an id counts as training side; repeated rows are scored alike; without labels every score
is the base rate; if all labels are toxic, nothing tells a word from
chance and none is learned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.session import settle, ship_package

SAMPLE = 20_000
FEATURE_BITS = 22
PREFIXES = (4, 5, 6)
SHRINK = 3.0
MIN_TOXIC = 3
MIN_RATE = 0.35
STRONGEST = 3
CUT = 0.7
REMEMBERED = 400_000
#: Minimum hashes of a signature: texts of similarity 0.5 agree once in 256, of 0.95 twice in three.
ALIKE = 8

LETTERS = 26
OTHER, EDGE, SYMBOLS = 26, 27, 28
#: Letters a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
    "£": "l", "¡": "i", "§": "s",
}
SWAP_COST = 1.0
MASK_COST = 3.0
DROP_SIGN_COST = 12.0
DROP_MARK_COST = 0.5
DROP_REPEAT_COST = 5.0
DROP_AGAIN_COST = 0.5
TRIM = ".,;:!?\"'()[]{}<>*#%&$|=+-_~/\\`^"
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
EDGE_SIGN = re.compile(r"(?:(?<![$@!|+(])[$@!|+(](?=\w))?\w.*\w(?:[$@]{1,2}(?![$@]))?")
#: Links and hex codes are not words; a letter four times in a row is no code.
LINK = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)\S")
CODE = re.compile(r"(?!.*(.)\1{3})(?=(?:\D*\d){4})(?:0x)?[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
PLAIN = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"(.)\1\1")


def _class_table() -> np.ndarray:
    table = np.full(0x3000, EDGE, dtype=np.int64)
    for c in range(0x3000):
        low = chr(c).lower()
        if len(low) == 1 and "a" <= low <= "z":
            table[c] = ord(low) - 97
        elif low.isalpha():
            table[c] = OTHER
    return table


CLASSES = _class_table()


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            codes = np.frombuffer(f"  {text}  ".encode("utf-32-le"), dtype="<u4")
            s = CLASSES[np.minimum(codes, 0x2FFF)]
            keep = np.concatenate([[True, True], ~((s[2:] == EDGE) & (s[1:-1] == EDGE) & (s[:-2] == EDGE))])
            s = s[keep]
            counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first two) over all documents; ``SYMBOLS**3`` numbers at any size."""
    grams = docs.where("text IS NOT NULL").select("text").mapInArrow(_trigram_counts, "gram bigint, n bigint")
    counts = np.zeros(SYMBOLS**3)
    for gram, n in grams.groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(axis=0)
    back = (bi + 0.1) / (bi + 0.1).sum(axis=1, keepdims=True)
    return np.log((tri + 5.0 * back) / (tri.sum(axis=2, keepdims=True) + 5.0)).astype(np.float32)


def _lattice(token: str) -> list[tuple[list[tuple[str, float]], float | None]]:
    """Per character: the letters it may stand for with costs, and the cost to drop it."""
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            repeat = i > 0 and token[i - 1] == c
            # Two of a letter are common spelling; in a longer run each is likely surplus.
            run = c * 3 in token[max(0, i - 2) : i + 3]
            out.append(([(c, 0.0)], None if not repeat else DROP_AGAIN_COST if run else DROP_REPEAT_COST))
        elif c == "*":
            out.append(([(chr(97 + k), MASK_COST) for k in range(LETTERS)], MASK_COST + 1))
        elif c in LEET:
            repeat = i > 0 and token[i - 1] == c
            out.append(([(x, SWAP_COST) for x in LEET[c]], SWAP_COST if repeat else DROP_SIGN_COST))
        else:
            out.append(([], DROP_MARK_COST))
    return out


def _code(letter: str) -> int:
    return ord(letter) - 97 if "a" <= letter <= "z" else OTHER


def _masked(states: dict, model: np.ndarray, nxt: dict) -> None:
    """Any letter after many states: the best last letter but one, for all pairs at once."""
    table = np.full((SYMBOLS, SYMBOLS), -np.inf)
    for (x, y), (score, _) in states.items():
        table[x, y] = score
    values = table[:, :, None] + model[:, :, :LETTERS] - MASK_COST
    at = values.argmax(axis=0)
    best = np.take_along_axis(values, at[None], axis=0)[0]
    for y, c in zip(*(i.tolist() for i in np.nonzero(best > -np.inf))):
        value, old = float(best[y, c]), nxt.get((y, c))
        if old is None or value > old[0]:
            nxt[y, c] = (value, (states[int(at[y, c]), y][1], chr(97 + c)))


def restore(token: str, model: np.ndarray, gaps: bool = False) -> str:
    """The likeliest letters behind one token: Viterbi over states (last two letters).

    With ``gaps`` a space may stand before any character, so the result may be several words.
    """
    # Letters are kept as (all before, letter), so a step costs the same in a long token.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for options, drop in _lattice(token):
        if gaps:
            for (x, y), (score, word) in list(states.items()):
                value = score + float(model[x, y, EDGE])
                if y != EDGE and ((y, EDGE) not in states or value > states[y, EDGE][0]):
                    states[y, EDGE] = (value, (word, " "))
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        many = len(options) == LETTERS and len(states) > 40
        for (x, y), (score, word) in states.items():
            if drop is not None:
                old = nxt.get((x, y))
                if old is None or score - drop > old[0]:
                    nxt[x, y] = (score - drop, word)
            row = model[x, y]
            for letter, cost in () if many else options:
                c = _code(letter)
                value = score + float(row[c]) - cost
                old = nxt.get((y, c))
                if old is None or value > old[0]:
                    nxt[y, c] = (value, (word, letter))
        if many:
            _masked(states, model, nxt)
        states = nxt
    word = max(states.items(), key=lambda s: s[1][0] + float(model[s[0][0], s[0][1], EDGE]))[1][1]
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


def _suspicious(token: str) -> bool:
    """Letters mixed with signs, or a letter three times in a row."""
    if PLAIN.fullmatch(token):
        return bool(TRIPLE.search(token))
    return any(c.isalpha() for c in token) and len(token) > 1


def readings(token: str, model: np.ndarray) -> list[str]:
    """Restored forms of one lower-case token: without its edge marks, and decoded."""
    bare = token.strip(TRIM)
    if not bare:
        return []
    forms = [bare]
    # A sign at an edge may stand for a letter too ("$tupid", "a$$"), unless it is a mark
    # of its own, such as an exclamation mark at the end or a run of signs.
    edged = EDGE_SIGN.search(token)
    for form in dict.fromkeys([bare, edged.group() if edged else bare]):
        if _suspicious(form) and not LINK.match(form) and not CODE.fullmatch(form):
            word = restore(form, model)
            if len(word) >= 3 and word not in forms:
                forms.append(word)
    return forms


def word_place(word: str) -> int:
    return zlib.crc32(b"w" + word.encode()) & (1 << FEATURE_BITS) - 1


def prefix_places(word: str) -> list[int]:
    mask = (1 << FEATURE_BITS) - 1
    return [zlib.crc32(b"p" + word[:k].encode()) & mask for k in PREFIXES if len(word) > k]


def tokens(text: str, model: np.ndarray | None = None) -> list[str]:
    """Lower-case tokens; a run of single characters also gives the words it may hold.

    Those are its pieces of 4 to 12 characters and, with ``model``, the words of the likeliest
    letters and gaps and the pieces of the likeliest letters, in which no letter is stretched.
    """
    low = text.lower()
    found = low.split()
    for run in SPACED.findall(low):
        joined = "".join(run.split())
        found.append(joined)
        pieces = [joined]
        if model is not None:
            found += restore(joined, model, gaps=True).split()
            pieces.append(restore(joined, model))
        for piece in dict.fromkeys(pieces):
            n = len(piece)
            found += [piece[i:j] for i in range(n) for j in range(i + 4, min(i + 13, n + 1)) if j - i < n or piece != joined]
    return found


def _sample_features(
    batches: Iterator[pa.RecordBatch], model: np.ndarray, strong: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to per-task counts (place, toxic documents, documents).

    Without ``strong`` words are counted; with it the prefixes of all other words, so that
    one toxic word alone does not make its prefix toxic.
    """
    skip = None if strong is None else set(strong.tolist())
    bad = np.zeros(1 << FEATURE_BITS, dtype=np.int32)
    all_ = np.zeros(1 << FEATURE_BITS, dtype=np.int32)
    cache: dict[str, list[int]] = {}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            places: set[int] = set()
            for token in set(tokens(text, model)):
                found = cache.get(token)
                if found is None:
                    words = readings(token, model)
                    if skip is None:
                        found = [word_place(w) for w in words]
                    else:
                        found = [p for w in words if word_place(w) not in skip for p in prefix_places(w)]
                    cache[token] = found
                places.update(found)
            at = np.fromiter(places, dtype=np.int64)
            all_[at] += 1
            if toxic:
                bad[at] += 1
        if len(cache) > REMEMBERED:
            cache.clear()
    at = np.flatnonzero(all_)
    for part in np.array_split(at, max(1, len(at) // 100_000)):
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bad[part].astype(np.int64)), pa.array(all_[part].astype(np.int64))], names=["place", "bad", "n"])


def _minhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two signatures of minimum hashes of the word pairs, in which near copies mostly agree."""
    rng = np.random.default_rng(2)
    flips, factors = (rng.integers(0, 2**64, 2 * ALIKE, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    for batch in batches:
        signatures = []
        for text in batch.column(1).to_pylist():
            w = text.lower().split()
            pairs = [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:])] or [zlib.crc32(text.encode())]
            hashes = np.unique(np.array(pairs, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            least = np.full(2 * ALIKE, 2**64 - 1, dtype=np.uint64)
            for start in range(0, len(hashes), 4096):
                np.minimum(least, ((hashes[start : start + 4096, None] ^ flips) * factors).min(axis=0), out=least)
            signatures.append((least[:ALIKE].tobytes(), least[ALIKE:].tobytes()))
        first, second = zip(*signatures) if signatures else ((), ())
        arrays = [*batch.columns, pa.array(first, pa.binary()), pa.array(second, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "text", "first", "second"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``toxic, text`` of the sample; near copies with the same label are one row."""
    side = F.crc32(F.col("doc_id").cast("string")) % 3
    train = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(side != 1)
    train = train.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (
        docs.where("text IS NOT NULL")
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most `sample` ids and flags
        .select("toxic", "text")
    )
    single = rows.mapInArrow(_minhash, "toxic int, text string, first binary, second binary")
    for key in ("first", "second"):
        single = single.groupBy("toxic", key).agg(F.max(F.struct("text", "first", "second")).alias("r")).select("toxic", "r.*")
    return single.select("toxic", "text")


def class_weights(rate: float) -> tuple[float, float, float]:
    """Weights of a toxic and of a clean row, and the share of toxic rows they lead to."""
    share = min(rate, MIN_RATE / 2)
    if share == rate or rate >= 1:
        return 1.0, 1.0, share
    toxic = float(np.log(rate) / np.log(share))
    return toxic, toxic * rate / (1 - rate) * (1 - share) / share, share


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE):
    """(places, rates) of words and of prefixes, and the base rate, from the training rows."""
    single = settle(training_rows(docs, labels, sample))
    base = single.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    rate = (base[0] or 0.0) if base[1] else 0.0
    if rate >= 1:
        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        return none, none, MIN_RATE / 2
    toxic, clean, share = class_weights(float(rate))

    def strong(without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        count = partial(_sample_features, model=model, strong=without)
        counts = single.mapInArrow(count, "place bigint, bad bigint, n bigint")
        total = counts.groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        bad = F.col("bad") * toxic
        shrunk = (bad + share * SHRINK) / (bad + (F.col("n") - F.col("bad")) * clean + SHRINK)
        clear = total.withColumn("rate", shrunk).where((F.col("bad") >= MIN_TOXIC) & (F.col("rate") >= MIN_RATE))
        # At most 2**FEATURE_BITS rows by construction.
        found = clear.select("place", "rate").orderBy("place").toArrow()
        return found.column("place").to_numpy(), found.column("rate").to_numpy()

    words = strong(None)
    prefixes = strong(words[0])
    return words, prefixes, share


def _scores(batches: Iterator[pa.RecordBatch], model: np.ndarray, words, prefixes, base: float) -> Iterator[pa.RecordBatch]:
    word_rate, prefix_rate = (dict(zip(p.tolist(), r.tolist())) for p, r in (words, prefixes))
    cache: dict[str, tuple[float, str]] = {}
    none = (0.0, "")

    def strongest(token: str) -> tuple[float, str]:
        best = none
        for word in readings(token, model):
            rate = max([word_rate.get(word_place(word), 0.0), *(prefix_rate.get(p, 0.0) for p in prefix_places(word))])
            if rate > best[0]:
                best = (rate, word)
        return best

    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            hits: dict[str, float] = {}
            for token in set(tokens(text, model)) if text else ():
                found = cache.get(token)
                if found is None:
                    found = cache[token] = strongest(token)
                if found[0]:
                    hits[found[1]] = max(found[0], hits.get(found[1], 0.0))
            miss = 1.0 - base
            top = sorted(hits.values(), reverse=True)[:STRONGEST]
            if top:
                miss = 1.0 - top[0]
                for rate in top[1:]:
                    # Further evidence counts as far as it is better than chance.
                    miss *= 1.0 - max(0.0, 2 * rate - 1) / 2
            out.append(min(1.0, max(0.0, 1.0 - miss)))
        if len(cache) > REMEMBERED:
            cache.clear()
        score = np.array(out, dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    ship_package(docs.sparkSession)
    model = character_model(docs)
    words, prefixes, base = fit(docs, labels, model, sample)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return plain.mapInArrow(
        partial(_scores, model=model, words=words, prefixes=prefixes, base=base),
        "doc_id bigint, held_out boolean, score double, predicted int",
    )
