"""Relaxation against one bone after the other, also where joints coincide or are missing."""

import numpy as np
import pytest

from motionlake import spec
from motionlake.functions import kernels as K


def plain(source, target, iterations):
    half = [0.5 * np.linalg.norm(source[:, b] - source[:, a], axis=-1) for a, b in spec.BONES]
    pose = target.copy()
    for _ in range(iterations):
        for (a, b), want in zip(spec.BONES, half):
            d = pose[:, b] - pose[:, a]
            size = np.sqrt((d * d).sum(axis=-1))
            gain = np.where(size <= 1e-8, 0.0, 0.5 - want / np.maximum(size, 1e-8))[:, None]
            pose[:, a] += d * gain
            pose[:, b] -= d * gain
    moved = 0.5 * (source[:, 11] + source[:, 12]) - 0.5 * (pose[:, 11] + pose[:, 12])
    return pose + moved[:, None]


@pytest.mark.parametrize("seed", range(6))
def test_relaxation_equals_single_bones(seed):
    rng = np.random.default_rng(seed)
    source, target = rng.normal(size=(2, 9, spec.JOINTS, 3))
    if seed % 2:
        target[2, 5], target[3] = target[2, 6], 0.0
    if seed % 3 == 2:
        target[1, 7, 0] = np.nan
    got = K.relax_bones(source, target, 20)
    np.testing.assert_allclose(got, plain(source, target, 20), rtol=1e-9, atol=1e-9)
