"""The steps that turn frames into terms compile to methods the JVM also compiles (8,000 bytes)."""

import numpy as np
import pytest

from motionlake.operators import distance as D

HUGE = 8000


def _largest_method(df):
    df.collect()
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def _pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(1, f, "clear", rng.normal(size=51).tolist(), rng.normal(size=51).tolist(), [1.0] * 17) for f in range(6)]
    return rows, spark.createDataFrame(rows, "clip_id int, frame int, skill string, s array<double>, t array<double>, c array<double>")


@pytest.mark.parametrize("training", [False, True])
def test_no_method_of_the_terms_is_left_to_the_interpreter(spark, training):
    _, df = _pairs(spark)
    terms = D.frame_terms(df, ["clip_id", "skill"], training)
    assert _largest_method(D.keypoint_components(terms, ["clip_id", "skill"])) < HUGE


def test_joint_terms_of_plain_arrays(spark):
    rows, df = _pairs(spark)
    got = {(r.frame, r.ja): r for r in D.frame_terms(df).where("kind = 0").collect()}
    s, t = (np.array([r[k] for r in rows]).reshape(-1, 17, 3) for k in (3, 4))
    assert len(got) == 6 * 17
    for (f, j), r in got.items():
        assert r.err == pytest.approx(np.linalg.norm(s[f, j] - t[f, j]))
        if f:
            assert r.verr == pytest.approx(np.linalg.norm((s[f, j] - s[f - 1, j]) - (t[f, j] - t[f - 1, j])))
        else:
            assert r.verr is None and r.vmask is None
