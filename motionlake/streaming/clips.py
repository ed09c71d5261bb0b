"""Frames in capture order and whole clips, out of a stream of joint observations.

An observation is ``clip_id, frame, ts, dims, joint, x, y, z, score``: one joint of one frame
in 2-D or 3-D; ``ts`` is the capture time and rises with the frame number. Rows may arrive in
any order within the watermark; later ones are dropped by the engine. All jobs here need the
RocksDB state store (:func:`state_store`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motionlake.operators import pose as P
from motionlake.plans import clips as PC
from motionlake.plans import scoring as PS
from motionlake.session import settle, ship_package

KEY = "clip_id"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a clip that leave the state at a time.
STEP = 10_000
#: Buckets of clips that share their state in an ordered stream, and rows of one stored message.
BUCKETS, PACK = 512, 100_000
#: Bucket of rows that name no clip.
NO_CLIP = -1


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _bring_forward(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer for the key, at ``at_ms`` or earlier; every call is a round trip, so none is spare."""
    known = list(handle.listTimers())
    if known and min(known) <= at_ms:
        return
    for old in known:
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


def _packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Rows as Arrow messages of at most ``PACK`` rows, the form in which they lie in the state."""
    out = []
    for at in range(0, len(rows), PACK):
        batch = pa.RecordBatch.from_pandas(rows.iloc[at : at + PACK], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(message: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(message)).read_all().to_pandas()


class OrderedFrames(StatefulProcessor):
    """Holds the joints of a bucket of clips until the watermark has passed their frame.

    Frames of a clip are released in order up to the first one the watermark has not passed,
    so the numbers of retained frames never have to be taken back. A frame that comes after a
    later one was released (its capture time does not rise with its number) is dropped.
    A bucket keeps one timer, that of its earliest frame, and looks at all its clips at once,
    because every call of the state is a round trip.
    """

    COLUMNS = ["frame", "us", "dims", "joint", "x", "y", "z", "score"]

    def __init__(self, require: Sequence[int]) -> None:
        self.require = sorted(set(require))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "part binary")
        self.place = handle.getListState("place", "part binary")

    def _places(self) -> pd.DataFrame | None:
        """Next number and last released frame of the bucket's clips, by clip."""
        parts = [_unpacked(m) for (m,) in self.place.get()]
        return pd.concat(parts).set_index(KEY) if parts else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        places, first = self._places(), None
        for part in rows:
            if places is not None:
                last = places["last"].reindex(part[KEY], fill_value=np.iinfo(np.int64).min)
                part = part[part["frame"].to_numpy() > last.to_numpy()]
            if len(part):
                self.buffer.appendList(_packed(part[[KEY, *self.COLUMNS]]))
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            _bring_forward(self.handle, first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [_unpacked(m) for (m,) in self.buffer.get()]
        if not parts:
            return
        held = pd.concat(parts, ignore_index=True).drop_duplicates()
        held["_clip"], clips = pd.factorize(held[KEY], use_na_sentinel=False)
        held = held.sort_values(["_clip", "frame", "dims", "joint"], kind="stable", ignore_index=True)
        by_frame = held.groupby(["_clip", "frame"])
        frames = by_frame["us"].max().reset_index()
        at = by_frame.ngroup().to_numpy()
        early = frames["us"] // 1000 + 1 > watermark
        shut = early.groupby(frames["_clip"]).cummax().to_numpy()
        self.buffer.clear()
        rest = held[shut[at]]
        if len(rest):
            self.buffer.appendList(_packed(rest[[KEY, *self.COLUMNS]]))
            # the timer that fired was the only one, and the engine removes it
            due = frames[shut].drop_duplicates("_clip")["us"].min()
            self.handle.registerTimer(int(due) // 1000 + 1)
        if shut.all():
            return
        kept = ~shut & self._complete(held, at, len(frames))
        places = self._places()
        if places is None:
            places = pd.DataFrame({"next": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64")})
        begin = places["next"].reindex(clips, fill_value=0).to_numpy()
        counted = pd.Series(kept.astype("int64")).groupby(frames["_clip"]).cumsum().to_numpy()
        number = begin[frames["_clip"]] + counted - 1
        moved = frames[~shut].assign(next=number[~shut] + 1).groupby("_clip").agg(next=("next", "last"), last=("frame", "last"))
        moved.index = pd.Index(clips).take(moved.index)
        places = pd.concat([places[~places.index.isin(moved.index)], moved]) if len(places) else moved
        self.place.put(_packed(places.rename_axis(KEY).reset_index()))
        out = held[kept[at]].drop(columns=["_clip", "us"]).rename(columns={"frame": "source_frame"})
        out.insert(1, "frame", number[at[kept[at]]].astype("int32"))
        out = out.astype({c: "float64" for c in ("x", "y", "z", "score")})
        if key[0] == NO_CLIP:
            out[KEY] = None
        for start in range(0, len(out), STEP):
            yield out.iloc[start : start + STEP]

    def _complete(self, rows: pd.DataFrame, at: np.ndarray, frames: int) -> np.ndarray:
        """Frames (rows are numbered with theirs) that have 2-D and 3-D joints, each with the required ones."""
        good = np.ones(frames, dtype=bool)
        for dims in (2, 3):
            own = (rows["dims"] == dims).to_numpy()
            for some in [own, *(own & (rows["joint"] == j).to_numpy() for j in self.require)]:
                good &= np.bincount(at[some], minlength=frames) > 0
        return good

    def close(self) -> None:
        pass


def ordered_frames(
    stream: DataFrame, require: Sequence[int] = (), min_score: float = 0.5, watermark: str = "10 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Joints of retained frames, numbered densely in capture order; each frame leaves once.

    The stream form of the confidence filter, the retained-frame filter and the source
    provenance: joints scored above ``min_score``, frames with 2-D and 3-D joints (each with
    the joints of ``require``), ``frame`` from 0 and ``source_frame`` as captured. The state
    of a clip is what the watermark has not passed yet. Clips share the state of one of
    ``buckets`` hash buckets; a task holds the waiting rows of one bucket, so many clips need
    more of them. The number belongs to the checkpoint and stays while the query lives.
    """
    ship_package(stream.sparkSession)
    rows = P.filter_confidence(stream, min_score).withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)
    kind = rows.schema[KEY].dataType
    # rows without a clip are a bucket of their own; beside numbers, nulls would turn them to floats
    bucket = F.when(F.col(KEY).isNull(), NO_CLIP).otherwise(F.pmod(F.xxhash64(KEY), F.lit(buckets))).cast("int")
    clip = F.coalesce(KEY, F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(KEY)
    rows = rows.select(
        bucket.alias("_bucket"), clip.alias(KEY), "ts", F.col("frame").cast("bigint").alias("frame"), "us", F.col("dims").cast("int").alias("dims"),
        F.col("joint").cast("int").alias("joint"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "score")],
    )
    schema = f"{KEY} {kind.simpleString()}, frame int, source_frame bigint, dims int, joint int, x double, y double, z double, score double"
    return rows.groupBy("_bucket").transformWithStateInPandas(OrderedFrames(require), schema, "Append", "EventTime")


class WholeClips(StatefulProcessor):
    """Holds all rows of a clip until nothing came for ``gap_us`` of event time.

    Rows more than the gap apart belong to different sessions, also when they arrive in one
    batch or before the timer of the earlier session fires. Rows leave the state in steps, so
    memory does not grow with the clip beyond one number per row.
    """

    def __init__(self, columns: Sequence[str], schema: T.StructType, gap_us: int) -> None:
        self.columns, self.schema, self.gap_us = list(columns), schema, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            clean = part[self.columns].astype(object).where(part[self.columns].notna(), None)
            self.buffer.appendList(list(clean.itertuples(index=False, name=None)))
            least = int(part["us"].min())
            first = least if first is None else min(first, least)
        _bring_forward(self.handle, self._due(first))
        return iter([])

    def _due(self, us: int) -> int:
        return (us + self.gap_us) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        place = self.columns.index("us")
        times = np.sort(np.fromiter((row[place] for row in self.buffer.get()), dtype=np.int64))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(times) > self.gap_us) + 1])
        begin, end = times[starts], times[np.concatenate([starts[1:], [len(times)]]) - 1]
        over = (end + self.gap_us) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs()
        rest: list[tuple] = []
        out: list[tuple] = []
        for row in self.buffer.get():
            session = int(np.searchsorted(begin, row[place], side="right")) - 1
            if not over[session]:
                rest.append(row)
                continue
            out.append((key[0], int(begin[session]), *row))
            if len(out) == STEP:
                yield self._frame(out)
                out = []
        self.buffer.clear()
        if rest:
            self.buffer.appendList(rest)
            self.handle.registerTimer(self._due(int(end[~over][0])))
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[KEY, "session", *self.columns])

    def close(self) -> None:
        pass


def whole_clips(stream: DataFrame, key: str = KEY, gap_seconds: float = 3600.0, watermark: str = "10 seconds") -> DataFrame:
    """Every row of a clip, once nothing of it arrived for the gap, with its ``session``.

    All columns of the stream but ``ts`` (which becomes ``us``) are kept. ``session`` is the
    first capture time of the session in microseconds. A clip is held by one task like any
    group of a stream; its rows pass through it in steps.
    """
    ship_package(stream.sparkSession)
    rows = stream.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts")).withColumnRenamed(key, KEY)
    columns = [c for c in rows.columns if c not in (KEY, "ts")]
    state = T.StructType([rows.schema[c] for c in columns])
    schema = T.StructType([rows.schema[KEY], T.StructField("session", T.LongType()), *state.fields])
    out = rows.groupBy(KEY).transformWithStateInPandas(
        WholeClips(columns, state, int(gap_seconds * 1e6)), schema, "Append", "EventTime"
    )
    return out.withColumnRenamed(KEY, key)


def scorer(
    clips: DataFrame,
    bank: DataFrame,
    calibration: DataFrame,
    target: str,
    require: Sequence[int] = (),
    min_score: float = 0.5,
    guidance: float = 0.5,
    model: PS.M.Model | None = None,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that grades completed clips against a stored expert bank.

    ``clips`` says what is known when a recording starts (skill, label, filename, fps),
    ``bank`` holds anchored 64-frame experts. The grades of a batch are one folder
    ``batch=<id>`` under ``target``; a batch that runs again after a failure replaces its
    own folder. Sessions of one clip in one batch are graded one after the other. A clip
    that fails anywhere is an error row with grade 0, as in a batch job.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{target}/batch={batch_id}"
        order = F.dense_rank().over(Window.partitionBy(KEY).orderBy("session"))
        # What a batch returns has the estimated size of what came in, which may be one row that
        # completes all clips. Stored it is computed once, and no side of the join is broadcast.
        held = settle(batch)
        sessions = settle(held.select(KEY, "session").distinct().withColumn("_nth", order))
        rows = settle(P.filter_confidence(held, min_score).join(sessions.hint("merge"), [KEY, "session"], "right"))
        most = sessions.agg(F.max("_nth")).first()[0] or 0
        for nth in range(1, most + 1):
            turn = rows.where(F.col("_nth") == nth)
            here = turn.select(KEY, "session").distinct()
            body, flat = (turn.where(F.col("dims") == d) for d in (3, 2))
            kept = settle(P.retain_frames(body, flat, require))
            body, flat = (
                t.withColumnRenamed("frame", "source_frame").join(kept, [KEY, "source_frame"]) for t in (body, flat)
            )
            sequence, summary = PC.prepare_clips(
                body.select(KEY, "frame", "joint", "x", "y", "z"),
                flat.select(KEY, "frame", "joint", "x", "y"),
                clips.join(here.select(KEY), KEY, "left_semi"),
            )
            grades = PS.grade_batch(settle(sequence), summary, bank, calibration, guidance, model=model)
            grades.join(here, KEY).write.mode("overwrite" if nth == 1 else "append").parquet(folder)

    return write


def read_scores(spark: SparkSession, target: str) -> DataFrame:
    """All grades that :func:`scorer` has written."""
    return spark.read.parquet(target).drop("batch")


__all__ = ["OrderedFrames", "WholeClips", "ordered_frames", "read_scores", "scorer", "state_store", "whole_clips"]
