"""Blocked windows and order statistics equal the plain definition, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motionlake.functions import ordered, timeblocks
from motionlake.operators import timewarp as W
from motionlake.operators import tracks as T


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(timeblocks, "BLOCK_FRAMES", 8)


def _track(spark, n=101, tracks=3):
    rng = np.random.default_rng(7)
    rows = [(t, f, float(x), float(y)) for t in range(tracks) for f, (x, y) in enumerate(rng.normal(size=(n - 30 * t, 2)).cumsum(0))]
    return spark.createDataFrame(rows, "track_id int, frame int, x double, y double"), rows


def _by_track(rows):
    out = {}
    for t, f, x, y in rows:
        out.setdefault(t, []).append((x, y))
    return {t: np.array(v) for t, v in out.items()}


def _smooth(p, k):
    padded = np.pad(p, ((k // 2, k // 2), (0, 0)), mode="edge")
    return np.stack([np.convolve(padded[:, d], np.ones(k) / k, "valid") for d in range(2)], 1)


def test_value_block_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=2000), 2.0 ** np.arange(-40, 40), -(2.0 ** np.arange(-40, 40)), [0.0], np.nextafter(2.0 ** np.arange(-5, 5), 0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", ordered.value_block(F.col("v")).alias("b")).orderBy("v").collect()
    blocks = [r.b for r in rows]
    assert blocks == sorted(blocks)


def test_percentiles_and_ranks_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    hot = [("hot", float(v)) for v in np.round(rng.gamma(2.0, size=3000), 2)]
    cold = [("cold", float(v)) for v in rng.normal(size=5)]
    df = spark.createDataFrame(hot + cold, "g string, v double")
    got = {r.g: (r.a, r.b, r.c) for r in ordered.exact_percentiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect()}
    for g, rows in (("hot", hot), ("cold", cold)):
        want = np.quantile([v for _, v in rows], [0.05, 0.5, 0.95])
        np.testing.assert_allclose(got[g], want, atol=1e-12)
    ranks = ordered.average_ranks(df, ["g"], "v")
    w = Window.partitionBy("g").orderBy("v")
    plain = df.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2.0)
    joined = plain.join(ranks, ["g", "v"]).where("abs(r - rank) > 1e-9")
    assert joined.count() == 0


@pytest.mark.parametrize("block", ["0", "frame div 7", "frame"])
def test_row_numbers_do_not_depend_on_blocks(spark, block):
    df, _ = _track(spark)
    out = ordered.number_rows(df.withColumn("k", F.col("frame") * 3), ["track_id"], ["k"], F.expr(block), "n", "total")
    assert out.where("n <> frame").count() == 0
    assert out.where("total <> 101 - 30 * track_id").count() == 0


def test_smoothing_and_peak_across_blocks(spark, tiny_blocks):
    df, rows = _track(spark)
    tracks = _by_track(rows)
    got = {(r.track_id, r.frame): (r.x_smooth, r.y_smooth) for r in T.moving_average(df).collect()}
    for t, p in tracks.items():
        np.testing.assert_allclose([got[t, f] for f in range(len(p))], _smooth(p, 5), atol=1e-9)
    peaks = {r.track_id: r for r in T.peak_window(df).collect()}
    for t, p in tracks.items():
        v = 10 * np.linalg.norm(np.diff(_smooth(p, 5), axis=0), axis=1)
        peak = int(np.argmax(10 * np.diff(v))) + 2
        assert (peaks[t].start, peaks[t].peak, peaks[t].end) == (max(0, peak - 30), peak, min(len(p) - 1, peak + 30))


def test_gap_filling_across_blocks(spark, tiny_blocks):
    df, rows = _track(spark)
    seen = df.withColumn("ok", (F.col("frame") % 40 > 30) & (F.col("track_id") < 2))
    filled = T.interpolate_gaps(seen, F.col("ok"))
    got = {(r.track_id, r.frame): r.x for r in filled.collect()}
    for t, p in _by_track(rows).items():
        f = np.arange(len(p))
        ok = (f % 40 > 30) & (t < 2)
        want = np.interp(f, f[ok], p[ok, 0]) if ok.any() else np.zeros(len(p))
        np.testing.assert_allclose([got[t, i] for i in f], want, atol=1e-9)


def test_nearest_frame_and_resample_across_blocks(spark, tiny_blocks):
    df, rows = _track(spark)
    tracked = df.where("frame % 11 = 3")
    got = {(r.track_id, r.frame): r.nearest for r in T.nearest_frame(df, tracked).collect()}
    for t, p in _by_track(rows).items():
        have = np.arange(3, len(p), 11)
        for f in range(len(p)):
            want = have[np.argmin(np.abs(have - f))]
            assert got[t, f] == want
    out = W.resample(df, 64, ("x", "y"), "track_id")
    got = {(r.track_id, r.frame): r.x for r in out.collect()}
    for t, p in _by_track(rows).items():
        want = np.interp(np.linspace(0, 1, 64), np.linspace(0, 1, len(p)), p[:, 0])
        np.testing.assert_allclose([got[t, g] for g in range(64)], want, atol=1e-9)


def test_velocity_and_acceleration_examples(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 3.0, 4.0), (0, 2, 6.0, 8.0)], "track_id int, frame int, x double, y double")
    assert [r.velocity for r in T.velocity(df).orderBy("frame").collect()] == [50.0, 50.0]
    speed = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (0, 2, 30.0)], "track_id int, frame int, velocity double")
    assert [r.acceleration for r in T.acceleration(speed).orderBy("frame").collect()] == [100.0, 100.0]


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    from motionlake import catalog

    run = catalog.entries()["w04_peak_window"].run
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(r) for r in run(spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
