"""Poses without a usable body frame: no axes, no error."""

import numpy as np
import pytest

from motionlake.operators import pose as P


def _joints(spark, poses):
    rows = [(0, f, j, *map(float, p[j]), 1.0, "right") for f, p in enumerate(poses) for j in range(17)]
    return spark.createDataFrame(rows, "clip_id int, frame int, joint int, x double, y double, z double, conf double, handedness string")


@pytest.mark.parametrize("dims", [2, 3])
def test_coinciding_shoulders_and_flat_torsos_are_skipped(spark, dims):
    rng = np.random.default_rng(1)
    poses = rng.normal(size=(4, 17, 3))
    poses[0, 6] = poses[0, 5]  # no shoulder width
    poses[1, [5, 6, 11, 12]] = [[-1, 0, 0], [1, 0, 0], [-3, 0, 0], [1, 0, 0]]  # torso along the shoulders
    if dims == 2:
        poses[:, :, 2] = 0
        poses[1] = poses[0]
    rows = P.unpack(P.normalize_pose(_joints(spark, poses), dims=dims)).collect()
    want = P.unpack(P.normalize_pose(_joints(spark, poses[[2, 2, 2, 3]]), dims=dims)).where("frame >= 2").collect()
    got = {(r.frame, r.joint): (r.x, r.y, r.z) for r in rows}
    assert len(rows) == 4 * 17 and all(None not in v for v in got.values())
    # the axes are those of the first frame that has them; the scale is another one
    for at in (2, 3):
        a = np.array([got[at, j] for j in range(17)])
        b = np.array([next((r.x, r.y, r.z) for r in want if (r.frame, r.joint) == (at, j)) for j in range(17)])
        assert np.allclose(a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-9)
    still = P.unpack(P.normalize_pose(_joints(spark, poses[[0, 0]]), dims=dims))
    assert still.where("x IS NULL OR isnan(x)").count() == 0 and still.count() == 34
