"""Small NumPy steps that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from motionlake import spec

_BONE_ENDS = np.array(spec.BONES)
_TRIPLET = np.array(spec.ANGLE_TRIPLETS)


def _bone_steps(bones: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Bones in order as ``(a, b, width)``: a left bone and the right one next to it go together.

    A bone moves up to its left twin only past bones that share no joint with it, so the
    sweep gives the same result as one bone after the other.
    """
    steps, done = [], set()
    for k, (a, b) in enumerate(bones):
        if k in done:
            continue
        width = 1
        for n in range(k + 1, len(bones)):
            passed = {j for m in range(k, n) if m not in done for j in bones[m]}
            if tuple(bones[n]) == (a + 1, b + 1) and not passed & {a + 1, b + 1}:
                done.add(n)
                width = 2
                break
        steps.append((a, b, width))
    return steps


_BONE_STEPS = _bone_steps(spec.BONES)


#: Working arrays of this process by name; fresh large ones would cost a page fault per 4 KB.
_SCRATCH: dict[str, np.ndarray] = {}


def _scratch(name: str, shape: tuple[int, ...]) -> np.ndarray:
    size = int(np.prod(shape))
    if name not in _SCRATCH or len(_SCRATCH[name]) < size:
        _SCRATCH[name] = np.empty(size)
    return _SCRATCH[name][:size].reshape(shape)


def _relax(pose: np.ndarray, wanted: dict[tuple, np.ndarray], pelvis: np.ndarray, iterations: int) -> None:
    """Relax ``pose`` (17, 3, F) in place; ``wanted`` has half the bone lengths of every step."""
    frames = pose.shape[2]
    along, shift = _scratch("along", (2, 3, frames)), _scratch("shift", (2, 3, frames))
    size, gain = _scratch("size", (2, frames)), _scratch("gain", (2, frames))
    # views are made once: 20 sweeps would pay for them again
    views = []
    for step in _BONE_STEPS:
        a, b, w = step
        d, m, r, g = along[:w], shift[:w], size[:w], gain[:w]
        views.append((pose[a : a + w], pose[b : b + w], wanted[step], d, m, m[:, 0], m[:, 1], m[:, 2], r, g, g[:, None]))
    for _ in range(iterations):
        for first, last, half, d, m, m0, m1, m2, r, g, wide in views:
            np.subtract(last, first, d)
            np.multiply(d, d, m)
            np.add(m0, m1, r)
            np.add(r, m2, r)
            np.sqrt(r, r)
            shut = None
            if not r.min() > 1e-8:  # also where a length is no number
                shut = r <= 1e-8
                np.maximum(r, 1e-8, out=r)
            np.divide(half, r, g)
            np.subtract(0.5, g, g)
            if shut is not None:
                g[shut] = 0.0
            np.multiply(d, wide, m)
            np.add(first, m, first)
            np.subtract(last, m, last)
    if iterations:  # a sweep does not depend on where the pose is, so it is put back once
        pose += pelvis - 0.5 * (pose[11] + pose[12])


def _wanted(own: np.ndarray) -> tuple[dict[tuple, np.ndarray], np.ndarray]:
    """Half the bone lengths of every step and the pelvis of the source (17, 3, F)."""
    half = {}
    for a, b, w in _BONE_STEPS:
        gap = own[b : b + w] - own[a : a + w]
        half[a, b, w] = 0.5 * np.sqrt((gap * gap).sum(axis=1))
    return half, 0.5 * (own[11] + own[12])


def relax_bones(source: np.ndarray, target: np.ndarray, iterations: int) -> np.ndarray:
    """Move target joints (F, 17, 3) towards the bone lengths of the source frames.

    Every sweep visits the bones in order and shares a length error between both ends,
    then puts the pelvis back where the source has it. Frames are independent.
    """
    # joints first: every step then works on contiguous (3, F) slices
    half, pelvis = _wanted(np.ascontiguousarray(source.transpose(1, 2, 0)))
    pose = np.array(target.transpose(1, 2, 0), dtype=float, order="C")
    _relax(pose, half, pelvis, iterations)
    return pose.transpose(2, 0, 1)


def joints_first(clips: np.ndarray) -> np.ndarray:
    """Clips (E, T, 17, 3) or confidences (E, T, 17) with the joint in front: contiguous slices per joint."""
    return np.ascontiguousarray(np.moveaxis(clips, (2, 3), (0, 1)) if clips.ndim == 4 else np.moveaxis(clips, 2, 0))


def relax_to(source: np.ndarray, targets: np.ndarray, iterations: int) -> np.ndarray:
    """Targets (17, 3, E, T) with the bone lengths of one source clip (17, 3, 1, T).

    The result lives until the next call in this process.
    """
    joints, axes, clips, frames = targets.shape
    half, pelvis = _wanted(source[:, :, 0])

    def spread(name: str, value: np.ndarray) -> np.ndarray:  # (n, T) -> (n, E * T)
        wide = _scratch(name, (len(value), clips, frames))
        wide[:] = value[:, None]
        return wide.reshape(len(value), clips * frames)

    pose = _scratch("pose", (joints, axes, clips * frames))
    pose[:] = targets.reshape(pose.shape)
    _relax(pose, {step: spread(f"half {step}", v) for step, v in half.items()}, spread("pelvis", pelvis), iterations)
    return pose.reshape(targets.shape)


def _length(gap: np.ndarray) -> np.ndarray:
    """Length of vectors (J, 3, ...) along the second axis; spoils ``gap``."""
    gap *= gap
    total = gap[:, 0] + gap[:, 1]
    total += gap[:, 2]
    return np.sqrt(total, out=total)


def _total(values: np.ndarray) -> np.ndarray:
    """Sum of (J, E, T) by clip; the same for a clip wherever it lies."""
    return values.sum(axis=0).sum(axis=-1)


def _mean(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean of (J, E, T) by clip; 0 where nothing is observed."""
    total = _total(mask)
    return np.where(total < 1e-8, 0.0, _total(values * mask) / np.where(total < 1e-8, 1.0, total))


def _angles(pose: np.ndarray) -> np.ndarray:
    at = pose[_TRIPLET[:, 1]]
    u, v = pose[_TRIPLET[:, 0]] - at, pose[_TRIPLET[:, 2]] - at
    dot = u * v
    dot = dot[:, 0] + dot[:, 1] + dot[:, 2]
    size = _length(u) * _length(v)
    cosine = np.where(size > 1e-8, dot / np.where(size > 1e-8, size, 1.0), 1.0)
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _lean(pose: np.ndarray) -> np.ndarray:
    axis = 0.5 * ((pose[5] + pose[6]) - (pose[11] + pose[12]))
    return np.arctan2(axis[2], axis[1])


def _transition(source: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    joints = list(spec.TRANSITION_JOINTS)
    own, other = source[joints], targets[joints]
    moved = (own - own[..., :1]) - (other - other[..., :1])
    error, seen = _length(moved), mask[joints] * mask[joints][..., :1]
    lower = 0.5 * _mean(error, seen) + 0.5 * _mean(error[..., -1:], seen[..., -1:])
    own, other = _lean(source), _lean(targets)
    turned = np.abs((own - own[..., :1]) - (other - other[..., :1]))[None]
    torso = np.prod(mask[list(spec.LEAN_JOINTS)], axis=0)[None]
    seen = torso * torso[..., :1]
    lean = 0.5 * _mean(turned, seen) + 0.5 * _mean(turned[..., -1:], seen[..., -1:])
    return 0.65 * lower + 0.35 * lean


#: Clips that are measured at a time, so that arrays stay in the cache.
AT_ONCE = 8


def _by_clips(measure: Callable[..., np.ndarray], source: np.ndarray, targets: np.ndarray, mask: np.ndarray, *more) -> np.ndarray:
    parts = [
        measure(source, targets[:, :, at : at + AT_ONCE], mask[:, at : at + AT_ONCE], *more) for at in range(0, targets.shape[2], AT_ONCE)
    ]
    return np.concatenate(parts)


def correction_distances(
    source: np.ndarray, targets: np.ndarray, mask: np.ndarray, skill: str, transition: bool = True
) -> np.ndarray:
    """Weighted distance of one clip (17, 3, 1, T) to each of E targets (17, 3, E, T), mask (17, E, T)."""
    return _by_clips(_correction, source, targets, mask, skill, transition)


def _correction(source: np.ndarray, targets: np.ndarray, mask: np.ndarray, skill: str, transition: bool) -> np.ndarray:
    joint_weight = np.array(spec.JOINT_WEIGHTS[skill])[:, None, None]
    w = spec.COMPONENT_WEIGHTS
    gap = source - targets
    step = _length(gap[..., 1:] - gap[..., :-1])
    weighted = mask * joint_weight
    total = w["position"] * _mean(_length(gap), weighted)
    total += w["velocity"] * _mean(step, weighted[..., 1:] * mask[..., :-1])
    a, b = _BONE_ENDS[:, 0], _BONE_ENDS[:, 1]
    own, other = _length(source[a] - source[b]), _length(targets[a] - targets[b])
    total += w["bone_length"] * _mean(np.abs(own - other), mask[a] * mask[b])
    seen = mask[_TRIPLET[:, 0]] * mask[_TRIPLET[:, 1]] * mask[_TRIPLET[:, 2]]
    turned = np.abs(_angles(source) - _angles(targets)) / np.pi
    total += w["angle"] * _mean(turned, seen)
    factor = spec.TRANSITION_WEIGHT[skill] if transition else 0.0
    if factor:
        total += factor * _transition(source, targets, mask)
    return total


def euclidean_distances(source: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean joint distance (17, 3, 1, T) to each target (17, 3, E, T); infinite without any overlap."""
    return _by_clips(_euclidean, source, targets, mask)


def _euclidean(source: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    error = _length(targets - source)
    total = _total(mask)
    error *= mask
    return np.where(total > 1e-8, _total(error) / np.where(total > 1e-8, total, 1.0), np.inf)


#: Cells of the cost table kept at a time.
WARP_CELLS = 1 << 22


def _warp_rows(a: np.ndarray, b: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Cost rows below ``above`` for the points ``a`` against all of ``b``."""
    m, n = len(a), len(b)
    cost = np.full((m + 1, n + 1), np.inf)
    cost[0] = above
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        best = np.minimum(np.minimum(cost[i - 1, j - 1], cost[i - 1, j]), cost[i, j - 1])
        gap = a[i - 1] - b[j - 1]
        cost[i, j] = np.sqrt((gap * gap).sum(axis=-1)) + best
    return cost


def warping_path(a: np.ndarray, b: np.ndarray, cells: int = WARP_CELLS) -> tuple[np.ndarray, float]:
    """Cheapest monotone alignment of two tracks and its cost.

    The cost table is filled along anti-diagonals, some rows at a time: only the last row
    of every band is kept, and going back the bands are filled again one by one. So tracks
    of any length need about ``cells`` cells and one row per band. Going back, a diagonal
    step wins ties, then a step in ``a``, then one in ``b``.
    """
    m, n = len(a), len(b)
    band = max(1, min(m, cells // (n + 1)))
    edges = [np.full(n + 1, np.inf)]
    edges[0][0] = 0.0
    for s in range(0, m, band):
        edges.append(_warp_rows(a[s : s + band], b, edges[-1])[-1].copy())
    steps, i, j = [], m, n
    cost = np.zeros((0, 0))
    base = m + 1
    while i > 0 and j > 0:
        if i <= base:
            base = (i - 1) // band * band
            cost = _warp_rows(a[base : base + band], b, edges[base // band])
        steps.append((i - 1, j - 1))
        k = i - base
        move = int(np.argmin((cost[k - 1, j - 1], cost[k - 1, j], cost[k, j - 1])))
        i, j = i - (move != 2), j - (move != 1)
    return np.array(steps[::-1]).reshape(-1, 2), float(edges[-1][n])
