"""Ordered frames keep their state by buckets of clips, not by clip."""

import pandas as pd
import pytest
from test_clip_streams import at, to_files, drain

from motionlake.streaming import clips as C
from motionlake.streaming import jobs as J

pytest.importorskip("google.protobuf")


class Listed:
    """A list state that counts its calls."""

    def __init__(self, handle):
        self.rows, self.handle = [], handle

    def _call(self, rows):
        self.handle.calls += 1
        self.rows = rows

    def get(self):
        self.handle.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self._call(self.rows + rows)

    def put(self, rows):
        self._call(list(rows))

    def clear(self):
        self._call([])


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = 0, [], {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Listed(self))

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at_ms):
        self.calls += 1
        self.timers.append(at_ms)

    def deleteTimer(self, at_ms):
        self.calls += 1
        self.timers.remove(at_ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def rows(clips, frames, first=0):
    """Joint 1 in 2-D and 3-D; odd frames have no 2-D joint. Frame f of clip c is taken at second f + c % 2."""
    found = [(c, f, (f + c % 2) * 1_000_000, d, 1, 0.5, float(f), None, 0.9) for c in clips for f in range(first, frames) for d in (3, 2) if d == 3 or f % 2 == 0]
    return pd.DataFrame(found, columns=["clip_id", *C.OrderedFrames.COLUMNS]).astype({"z": float})


def test_calls_of_the_state_do_not_follow_the_clips():
    handle, clips = Handle(), range(300)
    processor = C.OrderedFrames([1])
    processor.init(handle)
    whole = rows(clips, 6)
    late = whole[whole["frame"] < 2].iloc[:40]
    got = []
    for part, watermark in ((whole[::2], 0), (whole[1::2], 3000), (late, 3500), (late[:0], 10**6)):
        if len(part):
            list(processor.handleInputRows((0,), iter([part, part]), Clock(watermark)))
        while handle.timers and min(handle.timers) <= watermark:
            fired = min(handle.timers)
            got += list(processor.handleExpiredTimer((0,), Clock(watermark), None))
            handle.timers.remove(fired)
    out = pd.concat(got)
    # even frames stay, each with its two joints, and number densely in every clip
    want = sorted((c, f // 2, f, d) for c in clips for f in (0, 2, 4) for d in (2, 3))
    assert sorted(out[["clip_id", "frame", "source_frame", "dims"]].itertuples(index=False, name=None)) == want
    assert handle.calls < 60


def test_clips_of_any_key_share_buckets(spark, tmp_path):
    schema = "clip_id bigint, frame bigint, ts timestamp, dims int, joint int, x double, y double, z double, score double"
    ids = [None, 2**53 + 1, 2**53, 7]
    found = [(c, f, at(f), d, 1, float(f), 0.0, None, 0.9) for c in ids for f in range(4) for d in (2, 3)]
    for part in (found[::2], found[1::2], [(-1, 0, at(10**6), 2, 1, 0.0, 0.0, None, 0.9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), schema, 1)
    drain(spark, C.ordered_frames(stream, (1,), watermark="10 seconds", buckets=1), tmp_path, to_files(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(c, f, f, d) for c in ids for f in range(4) for d in (2, 3)}
    assert {(r.clip_id, r.frame, r.source_frame, r.dims) for r in got} == want and len(got) == len(want)
