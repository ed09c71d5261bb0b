"""Incremental ingest, stored pages and progress that follows writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_io_streams import _archive

from motionlake.operators import annotations as A
from motionlake.operators import paging
from motionlake.operators import sampling as S
from motionlake.sources import archives, increment
from motionlake.streaming import jobs as J
from motionlake.streaming import progress as G


def actions(df):
    return sorted((os.path.basename(r.path), r.action) for r in df.collect())


def full(spark, folder):
    rows = archives.load_archives(spark, str(folder)).collect()
    return {os.path.basename(r.path): (r.skill, r.error, None if r.seq is None else len(r.seq), None if r.seq is None else r.seq[0][0]) for r in rows}


def stored(spark, out):
    return {os.path.basename(r.path): (r.skill, r.error, None if r.seq is None else len(r.seq), None if r.seq is None else r.seq[0][0]) for r in increment.stored_clips(spark, out).collect()}


def test_a_second_run_decodes_only_what_changed(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for label in ("experts", "beginners"):
        (source / label).mkdir(parents=True)
        for i in range(3):
            _archive(source / label / f"{label[0]}{i}.npz")
    (source / "beginners" / "broken.npz").write_bytes(b"no archive")
    first = increment.ingest_changes(spark, str(source), out)
    assert [a for _, a in actions(first)] == ["decoded"] * 7 and stored(spark, out) == full(spark, source)
    assert actions(increment.ingest_changes(spark, str(source), out)) == []
    np.savez_compressed(source / "experts" / "e1.npz", skeleton_3d=np.full((30, 17, 3), 2.0), confidence=np.ones((30, 17)), skill=np.asarray("lift"))
    os.utime(source / "experts" / "e2.npz", (2_000_000_000, 2_000_000_000))
    assert actions(increment.ingest_changes(spark, str(source), out)) == [("e1.npz", "decoded"), ("e2.npz", "touched")]
    assert stored(spark, out) == full(spark, source)
    monkeypatch.setattr(increment, "NAMED_FILES", 0)  # all contents are scanned from here
    os.remove(source / "beginners" / "b0.npz")
    _archive(source / "beginners" / "b9.npz")
    assert actions(increment.ingest_changes(spark, str(source), out)) == [("b0.npz", "removed"), ("b9.npz", "decoded")]
    _archive(source / "beginners" / "b0.npz")
    assert actions(increment.ingest_changes(spark, str(source), out)) == [("b0.npz", "decoded")]
    assert stored(spark, out) == full(spark, source)
    summary = {os.path.basename(r.path): r for r in increment.ingest_summary(spark, out).collect()}
    assert len(summary) == 8 and summary["broken.npz"].status == "error" and summary["broken.npz"].frames == 0
    assert summary["e1.npz"].frames == 30 and summary["e1.npz"].skill == "lift" and summary["b9.npz"].label == "beginners"


def test_pages_equal_offset_and_read_few_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(v), i, f"t{i}") for i, v in enumerate(rng.integers(0, 50, 5000))]
    rows += [(7, 5000 + i, "same") for i in range(2500)]  # a third share one value
    df = spark.createDataFrame(rows, "v int, id int, text string").repartition(6)
    path = str(tmp_path / "pages")
    assert paging.write_pages(df, ["v", "id"], path, 500) == 7500
    for offset in (0, 399, 4321, 99_999):
        got = paging.read_page(spark, path, offset)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in S.page(df, ["v", "id"], offset).collect()]
        assert len({os.path.dirname(f) for f in got.inputFiles()}) <= 2
    parts = spark.read.parquet(f"{path}/index").collect()
    assert len(parts) == 15 and max(r.n for r in parts) < 1500
    seen = [r.id for start in range(0, 7500, 1000) for r in paging.read_page(spark, path, start, 1000).collect()]
    assert len(seen) == len(set(seen)) == 7500
    paging.write_pages(df.limit(0), ["v"], str(tmp_path / "none"))
    assert paging.read_page(spark, str(tmp_path / "none"), 0).count() == 0


def test_progress_follows_every_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "FOLD_EVERY", 2)
    target = str(tmp_path / "t")
    rng = np.random.default_rng(1)
    samples = spark.createDataFrame([(i, ("clear", "lift")[i % 2], f"k{i % 3}", ("experts", "beginners")[i % 4 // 2]) for i in range(60)], "sample_id int, skill string, key_frame string, cohort string")
    write = G.progress_writer(target, samples, ["seq"], buckets=4)
    assert G.read_progress(spark, target) is None
    history, last = [], None
    for batch_id in range(5):
        rows = [(int(i), batch_id * 10 + k, *[(None, "", ""), (5.0, "text", "more"), (None, "text", ""), (7.0, "", "")][int(rng.integers(4))]) for k, i in enumerate(rng.integers(0, 70, 9))]
        if batch_id == 3:
            rows = [(i, s - 100, *rest) for i, s, *rest in rows]  # older than all others
        batch = spark.createDataFrame(rows, "sample_id int, seq int, score double, feedback string, correction string")
        write(batch, batch_id)
        if batch_id == 2:
            write(batch, batch_id)  # again after the state was written
        history += rows
        if batch_id in (0, 3):
            continue
        every = spark.createDataFrame(history, batch.schema)
        want = A.annotation_progress(samples, A.latest_annotations(every, ["seq"]))
        got = G.read_progress(spark, target)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # A failure between the changes and the state: the state is unchanged, the changes are replaced.
    monkeypatch.setattr(J, "latest_writer", lambda *a: (lambda *b: (_ for _ in ()).throw(RuntimeError("lost"))))
    broken = G.progress_writer(target, samples, ["seq"], buckets=4)
    batch = spark.createDataFrame([(3, 999, 1.0, "new", "new")], "sample_id int, seq int, score double, feedback string, correction string")
    with pytest.raises(RuntimeError):
        broken(batch, 9)
    assert sorted(map(tuple, G.read_progress(spark, target).collect())) == sorted(map(tuple, got.collect()))
    write(batch, 9)
    every = spark.createDataFrame([*history, (3, 999, 1.0, "new", "new")], batch.schema)
    want = A.annotation_progress(samples, A.latest_annotations(every, ["seq"]))
    assert sorted(map(tuple, G.read_progress(spark, target).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(F.sum("n")).first()[0] == 60
