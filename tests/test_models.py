"""Model sessions in the Python workers: loads, batches and results."""

import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_matching import bank, frames  # noqa: F401

from motionlake.operators import matching as M
from motionlake.operators import models


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Input:
    name = "features"


class Identity:
    """Returns the source pose and writes one line per load and per batch."""

    def __init__(self, folder, fixed=None, scale=1.0):
        self.folder, self.fixed, self.scale = folder, fixed, scale
        self.note("load")

    def note(self, what):
        with open(f"{self.folder}/{what}-{os.getpid()}", "a") as out:
            out.write("x\n")

    def get_inputs(self):
        return [Input()]

    def run(self, outputs, feed):
        features = feed["features"]
        assert features.dtype == np.float32 and features.shape[1:] == (64, 17, 7)
        assert self.fixed is None or len(features) == self.fixed
        self.note("run")
        return [features[..., :3] * self.scale]


def lines(folder, what):
    return {p.name: len(p.read_text().split()) for p in folder.iterdir() if p.name.startswith(what)}


def aligned(df):
    anchors = F.array(*[F.lit(v) for v in (0, 16, 32, 48, 63)])
    return df.where("label = 'beginners'").withColumn("anchors", anchors), df.where("label = 'experts'")


def table(df):
    return {(r.clip_id, r.frame): np.array(r.t) for r in df.select("clip_id", "frame", "t").collect()}


def test_identity_session_equals_no_model_and_loads_once_per_worker(spark, bank, tmp_path):  # noqa: F811
    _, df = bank
    students, experts = aligned(df)
    folder = str(tmp_path)
    model = models.session_model(f"identity-{folder}", lambda: Identity(folder, fixed=1))
    for _ in range(2):  # a second job finds the sessions of the first
        got = table(M.correct_clips(students.repartition(5), experts, model))
    want = table(M.correct_clips(students, experts))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-5) for k in want)
    assert set(lines(tmp_path, "load").values()) == {1}
    assert sum(lines(tmp_path, "run").values()) >= 3 and len(lines(tmp_path, "load")) <= 8


def test_larger_batches_and_another_model(spark, bank, tmp_path):  # noqa: F811
    _, df = bank
    students, experts = aligned(df)
    folder = str(tmp_path)
    matches = M.match_expert(students, experts)
    rows = M.with_expert(students, experts, matches).drop("anchors")
    out = models.session_model(f"half-{folder}", lambda: Identity(folder, scale=0.5), clips_per_batch=4)(rows)
    assert out.columns == [*rows.columns, "m"] and out.count() == 3 * 64
    for r in out.collect():
        assert np.allclose(np.array(r.s) * 0.5, r.m, atol=1e-5)
    assert models.session_model("none", lambda: Identity(folder))(rows.limit(0)).count() == 0


def test_wrong_shape_is_an_error(spark, bank, tmp_path):  # noqa: F811
    _, df = bank
    students, experts = aligned(df)
    folder = str(tmp_path)

    class Wrong(Identity):
        def run(self, outputs, feed):
            return [feed["features"]]

    rows = M.with_expert(students, experts, M.match_expert(students, experts))
    with pytest.raises(Exception, match="instead of"):
        models.session_model(f"wrong-{folder}", lambda: Wrong(folder))(rows).select("m").collect()


def test_any_object_is_shared_by_name(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/load-{os.getpid()}", "a") as out:
            out.write("x\n")
        return 3

    df = spark.range(0, 1000, 1, 20)
    for _ in range(2):
        out = models.map_shared(df, "id bigint", f"three-{folder}", load, lambda three, batch: batch * three)
        assert out.agg(F.sum("id")).first()[0] == 3 * 999 * 500
    assert set(lines(tmp_path, "load").values()) == {1}


class Poses(Identity):
    """Returns the target pose."""

    def run(self, outputs, feed):
        return [feed["features"][..., 3:6]]


def test_clips_that_share_a_number_and_span_batches(spark, tmp_path):
    """A number given to two recordings, the second a short one: every row gets a prediction."""
    rng = np.random.default_rng(5)
    rows = [(k, f, p.tolist(), (p + 1).tolist(), [1.0] * 17) for k, n in ((1, 64), (1, 20), (2, 64), (3, 64), (3, 64)) for f in range(n) for p in [rng.normal(size=51)]]
    table = spark.createDataFrame(rows, "clip_id int, frame int, s array<double>, t array<double>, own_c array<double>").repartition(7)
    folder = str(tmp_path)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for limit, per_batch in ((size, 2), (50, 1), (50, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
        try:
            out = models.session_model(f"poses-{folder}-{per_batch}", lambda: Poses(folder), per_batch)(table).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert len(out) == len(rows) and all(np.allclose(np.array(r.s) + 1, r.m, atol=1e-5) for r in out)
    short = models.session_model(f"short-{folder}", lambda: Poses(folder))(table.where("clip_id <> 2 OR frame <> 5"))
    with pytest.raises(Exception, match="clip 2 does not have 64 frames"):
        short.collect()
