"""Archives, text tables and streams."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import detections
from motionlake.sources import archives, tables
from motionlake.streaming import jobs as J


def _archive(path, **extra):
    np.savez_compressed(
        path, skeleton_3d=np.ones((64, 17, 3), np.float32), skeleton_2d=np.ones((64, 17, 2), np.float32),
        confidence=np.ones((64, 17), np.float32), skill=np.asarray("clear"), handedness=np.asarray("left"), video_name=np.asarray("a.mp4"),
        analysis_window=np.array([1, 2, 9]), phase_indices=np.array([0, 8, 20, 40, 63]), fps=np.asarray(30.0), **extra,
    )


def test_archives_become_partitioned_clips_and_errors(spark, tmp_path):
    for label in ("experts", "beginners"):
        (tmp_path / "in" / label).mkdir(parents=True)
    _archive(tmp_path / "in" / "experts" / "e1.npz")
    _archive(tmp_path / "in" / "beginners" / "b1.npz", source_frame_indices=np.arange(64))
    (tmp_path / "in" / "beginners" / "broken.npz").write_bytes(b"not an archive")
    assert archives.list_sequences(spark, str(tmp_path / "in"), "experts").count() == 1
    errors = archives.ingest_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [r.clip_id for r in errors] == ["broken"]
    clips = archives.read_clips(spark, str(tmp_path / "out"), skill="clear", label="experts")
    row = clips.first()
    assert row.phase_indices == [0, 8, 20, 40, 63] and row.source_frame_indices is None and row.fps == 30.0
    assert archives.clip_frames(clips).count() == 64


def test_media_listing_filters_suffix_and_names(spark, tmp_path):
    for name in ("a.MP4", "b.mov", "c.txt", "d.mp4"):
        (tmp_path / name).write_bytes(b"x")
    only = spark.createDataFrame([("a.MP4",), ("b.mov",), ("c.txt",)], "filename string")
    assert [r.filename for r in archives.list_media(spark, str(tmp_path), only=only).collect()] == ["a.MP4", "b.mov"]


def test_missing_columns_and_calibrations_are_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "filename string, total_grade double")
    tables.write_csv(df, str(tmp_path / "g"))
    with pytest.raises(ValueError, match="label"):
        tables.read_grades(spark, str(tmp_path / "g"), ["filename", "label"])
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        tables.read_calibration(spark, str(tmp_path / "empty"))
    tables.write_documents(spark.createDataFrame([('{"filename": "x"}',)], "document string"), str(tmp_path / "d"))
    assert tables.read_documents(spark, str(tmp_path / "d")).first().filename == "x"
    assert tables.concat_scores(None, None, spark).count() == 0


def _drain(stream, folder, **options):
    name = "t" + uuid.uuid4().hex
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_repeated_deliveries_count_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, f, start + dt.timedelta(seconds=f)) for f in range(20)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, ts timestamp")
    df.unionByName(df.where("frame % 3 = 0")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), "clip_id int, frame int, ts timestamp", 1)
    assert _drain(J.observations(stream), str(tmp_path / "state")).count() == 20


def test_late_rows_are_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "clip_id int, frame int, ts timestamp"
    folder = tmp_path / "in"
    for k, seconds in enumerate((range(0, 7200 * 3, 600), [0, 1], [7200 * 4])):
        rows = [(1, 1000 * k + i, start + dt.timedelta(seconds=int(s))) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        out = J.throughput(J.read_stream(spark, str(folder), schema), window="1 hour")
        run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).where(F.col("window_start") == F.lit(start)).collect()
    assert [r.frames for r in first] == [6]


def test_upserts_over_batches_keep_the_last_write(spark, tmp_path):
    write = J.latest_writer(str(tmp_path / "t"), ["seq"], buckets=4)
    one = spark.createDataFrame([(i, 0, "a") for i in range(10)], "sample_id int, seq int, feedback string")
    two = spark.createDataFrame([(3, 1, "b"), (4, -1, "old"), (11, 0, "new")], "sample_id int, seq int, feedback string")
    write(one, 0)
    write(two, 1)
    write(two, 1)
    state = {r.sample_id: r.feedback for r in J.read_latest(spark, str(tmp_path / "t")).collect()}
    assert len(state) == 11 and state[3] == "b" and state[4] == "a" and state[11] == "new"


def test_carry_forward_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = np.random.default_rng(0)
    rows = [(c, f, int(b)) for c in range(4) for f, b in enumerate(rng.integers(0, 3, 40))]
    df = spark.createDataFrame(rows, "clip_id int, frame bigint, boxes int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = J.read_stream(spark, str(tmp_path / "in"), "clip_id int, frame bigint, boxes int")
        got = _drain(J.carry_forward(stream), str(tmp_path / "state")).collect()
    finally:
        spark.conf.set(key, before)
    want = detections.carry_forward(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_upserts_survive_restarts_and_stay_few(spark, tmp_path, monkeypatch):
    from motionlake.streaming import jobs as J

    target = str(tmp_path / "state")
    want = {}
    monkeypatch.setattr(J, "FULL_EVERY", 3)
    for run in range(2):  # every run starts again at batch 0, as with a new checkpoint
        write = J.latest_writer(target, ["seq"], buckets=4)
        for batch_id in range(4):
            seq = 10 * run + batch_id
            rows = [(k, seq, f"{run}.{batch_id}", "") for k in range(batch_id, batch_id + 5)]
            batch = spark.createDataFrame(rows, "sample_id int, seq int, author string, feedback string")
            write(batch, batch_id)
            if batch_id == 2:  # a retry
                write(batch, batch_id)
            want |= {k: a for k, _, a, _ in rows}
    assert {r.sample_id: r.author for r in J.read_latest(spark, target).collect()} == want
    assert len(J._versions(spark, target)) <= 2 * J.FULL_EVERY


def test_endless_values_have_ranks(spark):
    from motionlake.functions import ordered

    values = [1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf"), 0.0, -0.5]
    table = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    got = {r.q: r.quantile for r in ordered.percentile_table(table, ["g"], "v", [i / 7 for i in range(8)]).collect()}
    want = [float("-inf"), -0.5, 0.0, 1.0, 2.0, 3.0, float("inf"), float("nan")]
    assert [repr(got[i / 7]) for i in range(8)] == [repr(w) for w in want]


def test_natural_order_of_long_numbers(spark):
    from motionlake.functions.columns import natural_key
    from pyspark.sql import functions as F

    names = ["a" + "9" * n for n in (1, 19, 20, 21, 40)] + ["a1" + "0" * 40, "a007", "A10", "a", "a10b", "b", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()
    want = ["", "a", "a007", "a9", "A10", "a10b", *("a" + "9" * n for n in (19, 20, 21, 40)), "a1" + "0" * 40, "b"]
    assert [r.n for r in rows] == want


def test_warping_in_bands_equals_one_table():
    import numpy as np

    from motionlake.functions import kernels

    rng = np.random.default_rng(3)
    for m, n in ((1, 1), (7, 5), (60, 45), (33, 80)):
        a, b = rng.integers(0, 4, (m, 2)).astype(float), rng.integers(0, 4, (n, 2)).astype(float)
        path, cost = kernels.warping_path(a, b)
        for cells in (1, 50, 400):
            other, same = kernels.warping_path(a, b, cells)
            assert same == cost and (other == path).all()


def test_halo_longer_than_a_block(spark):
    from motionlake.functions import timeblocks

    track = spark.createDataFrame([(0, f) for f in range(100)], "track_id int, frame int")
    seen = {}
    for r in timeblocks.with_halo(track, before=25, after=25, size=10).collect():
        seen.setdefault(r._block, set()).add(r.frame)
    for f in range(100):
        assert set(range(max(0, f - 25), min(100, f + 26))) <= seen[f // 10]


def test_every_student_is_matched_or_named(spark):
    from motionlake.operators import matching as M

    def clip(i, n, hand):
        return [(i, f, "clear", hand, [float(i)] * 51, [1.0] * 17) for f in range(n)]

    schema = "clip_id int, frame int, skill string, handedness string, p array<double>, c array<double>"
    bank = spark.createDataFrame([r for i in range(40) for r in clip(100 + i, 64, "right")], schema)
    rows = clip(1, 64, "right") + clip(2, 60, "right") + clip(3, 80, "right") + clip(4, 64, "left")
    students = spark.createDataFrame(rows, schema)
    found = {r.clip_id: r.expert_id for r in M.match_expert_euclidean(students, bank).collect()}
    errors = {r.clip_id: r.error for r in M.match_errors(students, bank).collect()}
    assert found == {1: 100} and set(errors) == {2, 3, 4} and "60" in errors[2] and "80" in errors[3]
    for block, chunk, limit in ((1, 3, 0), (2, 16, 0), (16, 7, 1 << 30)):
        old = M.BLOCK, M.CHUNK, M.BROADCAST_BYTES
        M.BLOCK, M.CHUNK, M.BROADCAST_BYTES = block, chunk, limit
        try:
            again = {r.clip_id: (r.expert_id, r.experts) for r in M.match_expert_euclidean(students, bank).collect()}
        finally:
            M.BLOCK, M.CHUNK, M.BROADCAST_BYTES = old
        assert again == {1: (100, 40)}
