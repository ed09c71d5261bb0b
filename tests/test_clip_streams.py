"""Ordered frames and whole clips of a stream against their batch forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_matching import clip

from motionlake.operators import pose as P
from motionlake.plans import clips as PC
from motionlake.plans import scoring as PS
from motionlake.streaming import clips as C
from motionlake.streaming import jobs as J

pytest.importorskip("google.protobuf")

START = dt.datetime(2024, 1, 1)
SCHEMA = "clip_id int, frame bigint, ts timestamp, dims int, joint int, x double, y double, z double, score double"


def at(seconds):
    return START + dt.timedelta(seconds=float(seconds))


def observations(clip_id, seq, start=0.0, rate=10.0, drop=None):
    """All joints of a clip in 3-D and 2-D (y down); ``drop(frame, dims, joint)`` leaves some out."""
    rows = []
    for f, pose in enumerate(seq):
        for j, (x, y, z) in enumerate(pose.tolist()):
            for d in (2, 3):
                if not (drop and drop(f, d, j)):
                    rows.append((clip_id, f, at(start + f / rate), d, j, x, y if d == 3 else -y, z if d == 3 else None, 0.9))
    return rows


def drain(spark, stream, tmp_path, sink):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        _run(spark, stream, tmp_path, sink)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _run(spark, stream, tmp_path, sink):
    with C.state_store(spark):
        writer = sink(stream.writeStream.option("checkpointLocation", str(tmp_path / "state")))
        writer.trigger(availableNow=True).start().awaitTermination()


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def to_files(tmp_path):
    return lambda w: w.format("parquet").option("path", str(tmp_path / "out"))


def source(spark, tmp_path):
    return J.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1)


def flush(spark, tmp_path):
    """An observation of another clip, far later: the watermark passes everything else."""
    add(spark, tmp_path, [(-1, 0, at(10**6), 2, 0, 0.0, 0.0, None, 0.9)])


def test_ordered_frames_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(3):
        gone = {(int(f), int(d)) for f, d in zip(rng.integers(0, 40, 8), rng.integers(2, 4, 8))}
        rows += observations(c, clip(0.1 * c)[:40], drop=lambda f, d, j: (f, d) in gone and (j == 10 or f % 2))
    rows = [r if rng.random() > 0.05 else (*r[:-1], 0.4) for r in rows]
    rows += rows[::7]  # delivered twice
    arrival = sorted(range(len(rows)), key=lambda i: (rows[i][2] - START).total_seconds() + rng.uniform(0, 1.5))
    for part in np.array_split(arrival, 3):  # out of order inside and across batches
        add(spark, tmp_path, [rows[i] for i in rng.permutation(part)])
        drain(spark, C.ordered_frames(source(spark, tmp_path), (9, 10), watermark="3 seconds"), tmp_path, to_files(tmp_path))  # a restart per batch
    late = (0, 1, at(0.1), 3, 0, 9.0, 9.0, 9.0, 0.9)
    flush(spark, tmp_path)
    add(spark, tmp_path, [late])
    drain(spark, C.ordered_frames(source(spark, tmp_path), (9, 10), watermark="3 seconds"), tmp_path, to_files(tmp_path))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    every = P.filter_confidence(spark.createDataFrame(rows, SCHEMA).distinct())
    body, flat = every.where("dims = 3"), every.where("dims = 2")
    kept = P.retain_frames(body, flat, (9, 10))
    want = every.withColumnRenamed("frame", "source_frame").join(kept, ["clip_id", "source_frame"])
    names = ["clip_id", "frame", "source_frame", "dims", "joint", "x", "y", "z", "score"]
    clean = lambda rows: sorted(tuple(-1e9 if v is None or v != v else v for v in r) for r in rows)
    assert clean(got) == clean(tuple(r) for r in want.select(*names).collect()) and got


def test_sessions_do_not_depend_on_batches(spark, tmp_path):
    """A pause longer than the gap starts another session, also inside one batch."""
    times = {1: [0, 1, 2, 30, 31, 100], 2: [5, 14, 23], 3: [0, 200]}
    rows = [(c, i, at(t), 2, 0, float(t), 0.0, None, 0.9) for c, ts in times.items() for i, t in enumerate(ts)]
    for part in (rows[1::2], rows[::2]):
        add(spark, tmp_path, part)
    flush(spark, tmp_path)
    drain(spark, C.whole_clips(source(spark, tmp_path), gap_seconds=10, watermark="1000 seconds"), tmp_path, to_files(tmp_path))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("clip_id", "session").agg(F.sort_array(F.collect_list("x")).alias("x"))
    found = sorted((r.clip_id, list(r.x)) for r in got.collect())
    assert found == [(1, [0, 1, 2]), (1, [30, 31]), (1, [100]), (2, [5, 14, 23]), (3, [0]), (3, [200])]


def swing(seed, hand_joint=10, frames=50):
    """A recording with one clear swing of the right hand."""
    rng = np.random.default_rng(seed)
    seq = clip(0.05 * seed)[:frames].copy()
    t = np.arange(frames)
    seq[:, hand_joint, 0] += 0.8 / (1 + np.exp(-(t - 25) / 1.5))
    seq[:, hand_joint, 1] += 0.6 * np.exp(-((t - 25) ** 2) / 30)
    seq[:, hand_joint - 2, 0] += 0.4 / (1 + np.exp(-(t - 24) / 2.0))
    return seq + rng.normal(scale=0.002, size=seq.shape)


@pytest.fixture(scope="module")
def recordings(spark):
    clips = {c: swing(c) for c in range(6)}
    clips[6] = swing(6)[:3]  # too short: an error row
    meta = spark.createDataFrame(
        [(c, "clear", "experts" if c < 3 else "beginners", f"clip_{c}.mp4", 10.0, "right") for c in clips],
        "clip_id int, skill string, label string, filename string, fps double, known_handedness string",
    )
    rows = {c: observations(c, seq, start=3.0 * c) for c, seq in clips.items()}
    every = spark.createDataFrame([r for part in rows.values() for r in part], SCHEMA)
    body, flat = every.where("dims = 3"), every.where("dims = 2")
    sequence, summary = PC.prepare_clips(body.select("clip_id", "frame", "joint", "x", "y", "z"), flat.select("clip_id", "frame", "joint", "x", "y"), meta)
    sequence, summary = sequence.cache(), summary.cache()
    calibration = spark.createDataFrame([("clear", 0.1, 2.0)], "skill string, distance_offset double, alpha double")
    bank = sequence.where("label = 'experts'").cache()
    return rows, meta, sequence, summary, bank, calibration


def grades(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_streamed_clips_are_graded_like_a_batch(spark, tmp_path, recordings):
    rows, meta, sequence, summary, bank, calibration = recordings
    target = str(tmp_path / "grades")
    score = C.scorer(meta, bank, calibration, target)
    rng = np.random.default_rng(3)
    flat = [r for part in rows.values() for r in part]
    arrival = sorted(range(len(flat)), key=lambda i: (flat[i][2] - START).total_seconds() + rng.uniform(0, 2))
    run = lambda: drain(spark, C.whole_clips(source(spark, tmp_path), gap_seconds=8, watermark="4 seconds"), tmp_path, lambda w: w.foreachBatch(score))
    for part in np.array_split(arrival, 2):  # runs over one checkpoint
        add(spark, tmp_path, [flat[i] for i in part])
        run()
    flush(spark, tmp_path)
    add(spark, tmp_path, [(0, 7, at(0.7), 3, 0, 99.0, 99.0, 99.0, 0.9)])  # far behind the watermark
    run()
    want = PS.grade_batch(sequence, summary, bank, calibration)
    got = C.read_scores(spark, target)
    assert grades(got.select(want.columns)) == grades(want)
    assert got.where("status = 'error'").count() == 1 and got.where("total_grade > 0").count() == 6


def test_a_repeated_batch_replaces_itself(spark, tmp_path, recordings):
    rows, meta, sequence, summary, bank, calibration = recordings
    target = str(tmp_path / "grades")
    score = C.scorer(meta, bank, calibration, target)
    batch = spark.createDataFrame([r for c in (3, 4) for r in rows[c]], SCHEMA).withColumn("session", F.lit(1).cast("bigint"))
    score(batch, 5)
    score(batch, 5)
    again = batch.where("clip_id = 3").withColumn("session", F.lit(2).cast("bigint"))
    score(batch.unionByName(again), 6)
    want = PS.grade_batch(sequence, summary, bank, calibration).where("clip_id IN (3, 4)")
    both = spark.read.parquet(target).drop("session")
    assert grades(both.where("batch = 5").select(want.columns)) == grades(want)
    twice = spark.read.parquet(target).where("batch = 6")
    assert sorted((r.clip_id, r.session) for r in twice.collect()) == [(3, 1), (3, 2), (4, 1)]


@pytest.mark.parametrize("folder", [False, True])
def test_table_streams_read_files_and_folders(spark, sf_dir, tmp_path, folder):
    """A table may be one file or a folder of part files; both give all rows."""
    from motionlake.catalog import entries

    for name in ("conversations", "events"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if folder:
            rows.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    got = entries()["st4_annotation_upserts"].run(spark, str(tmp_path))
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = table.groupBy("conv_id").agg(F.max("turn").alias("seq")).collect()
    assert sorted((r.sample_id, r.seq) for r in got.select("sample_id", "seq").collect()) == sorted(map(tuple, last))
    events = entries()["st1_observation_stream"].run(spark, str(tmp_path))
    assert events.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_a_timer_that_is_early_enough_costs_one_call():
    calls = []

    class Handle:
        timers = [40]

        def listTimers(self):
            calls.append("list")
            return iter(self.timers)

        def deleteTimer(self, at):
            calls.append(("delete", at))

        def registerTimer(self, at):
            calls.append(("register", at))

    C._bring_forward(Handle(), 50)
    assert calls == ["list"]
    C._bring_forward(Handle(), 30)
    assert calls == ["list", "list", ("delete", 40), ("register", 30)]
