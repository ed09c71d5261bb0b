"""Models and other costly objects that live in the executors' Python workers.

``shared`` gives one object per Python worker and name: tasks, batches and later jobs of the
same application find it again as long as Spark keeps the worker. Nothing but the function
that loads the object travels from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from motionlake import spec
from motionlake.operators.matching import Model
from motionlake.session import ship_package

KEY = "clip_id"

_SHARED: dict[str, Any] = {}


class Session(Protocol):
    """What an inference runtime offers: named inputs and ``run``."""

    def get_inputs(self) -> list[Any]: ...

    def run(self, outputs: list[str] | None, feed: dict[str, np.ndarray]) -> list[np.ndarray]: ...


def shared(name: str, load: Callable[[], Any]) -> Any:
    """The object called ``name`` of this Python worker; ``load`` runs where it is missing.

    The name stands for the object's content: another model needs another name.
    """
    if name not in _SHARED:
        _SHARED[name] = load()
    return _SHARED[name]


def map_shared(
    df: DataFrame, schema: str | T.StructType, name: str, load: Callable[[], Any], apply: Callable[[Any, pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """``apply(object, batch)`` over all rows with the worker's shared object."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield apply(shared(name, load), batch)

    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole clips out of rows sorted by clip; a clip may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        keys = _codes(rows)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None:
        yield rest


def _codes(rows: pa.Table) -> np.ndarray:
    """Number of the clip of every row, in order."""
    keys = rows.column(KEY).combine_chunks().dictionary_encode("encode")
    return keys.indices.to_numpy(zero_copy_only=False)


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(take of every row, first row of every take): rows of a repeated frame are of further takes."""
    clip, frame = _codes(rows), rows.column("frame").to_numpy()
    if not len(clip):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    new = np.concatenate([[True], (clip[1:] != clip[:-1]) | (frame[1:] != frame[:-1])])
    at = np.arange(len(clip))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    clips = int(clip[-1]) + 1
    first = new & (np.bincount(clip[new], minlength=clips)[clip] == spec.CLIP_FRAMES) & (frame >= 0) & (frame < spec.CLIP_FRAMES)
    short = np.flatnonzero(np.bincount(clip[first], minlength=clips) != spec.CLIP_FRAMES)
    if len(short):
        raise ValueError(f"clip {rows.column(KEY)[int(np.searchsorted(clip, short[0]))].as_py()} does not have {spec.CLIP_FRAMES} frames")
    takes = np.zeros(clips, dtype=int)
    np.maximum.at(takes, clip, copy + 1)
    start = np.concatenate([[0], np.cumsum(takes)])
    # frames that a further take lacks are those of the first
    source = np.repeat(at[new].reshape(clips, -1), takes, axis=0)
    take = start[clip] + copy
    source[take, frame] = at
    return take, source


def _numbers(rows: pa.Table, name: str, size: int) -> np.ndarray:
    values = rows.column(name).combine_chunks().flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return values.astype(np.float32).reshape(len(rows), spec.JOINTS, size)


def session_model(name: str, load: Callable[[], Session], clips_per_batch: int = 1) -> Model:
    """A correction model out of an inference session that every Python worker loads once.

    The session gets float32 features (clips, 64, 17, 7) under the name of its first input
    and returns (clips, 64, 17, 3); a session with a fixed batch of one clip is the default.
    Clips need 64 frames; confidences that are missing count as 0 and so do coordinates.
    Rows of a repeated frame are further takes of the clip, each with its own prediction.
    The result is the table with the predicted pose ``m``, for ``correct_clips(model=...)``.

    Frames reach the worker as rows sorted by clip, so a batch is bounded whatever a clip or
    a partition holds.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _clips(batches):
            session = shared(name, load)
            first = session.get_inputs()[0].name
            take, source = _places(rows)
            features = np.concatenate([_numbers(rows, "s", 3), _numbers(rows, "t", 3), _numbers(rows, "own_c", 1)], axis=2)
            poses = np.empty((len(rows), spec.JOINTS * 3))
            place = rows.column("frame").to_numpy()
            order = np.argsort(take, kind="stable")
            ends = np.searchsorted(take[order], np.arange(len(source) + 1))
            for at in range(0, len(source), clips_per_batch):
                part = np.ascontiguousarray(features[source[at : at + clips_per_batch]])
                out = np.asarray(session.run(None, {first: part})[0], dtype=np.float32)
                want = (len(part), spec.CLIP_FRAMES, spec.JOINTS, 3)
                if out.shape != want:
                    raise ValueError(f"the model returned {out.shape} instead of {want}")
                own = order[ends[at] : ends[min(at + clips_per_batch, len(source))]]
                poses[own] = out[take[own] - at, place[own]].reshape(len(own), -1)
            offsets = pa.array(np.arange(0, poses.size + 1, spec.JOINTS * 3, dtype=np.int32))
            found = rows.append_column("m", pa.ListArray.from_arrays(offsets, pa.array(poses.ravel())))
            yield from found.combine_chunks().to_batches()

    def model(rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)
        ordered = rows.repartition(KEY).sortWithinPartitions(KEY, "frame", "s", "t", "own_c")
        schema = T.StructType([*rows.schema.fields, T.StructField("m", T.ArrayType(T.DoubleType()))])
        return ordered.mapInArrow(predict, schema)

    return model


__all__ = ["Session", "map_shared", "session_model", "shared"]
