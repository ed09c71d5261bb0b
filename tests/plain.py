"""Whole jobs in plain NumPy, for small fixtures."""

import math

import numpy as np
from test_matching import loop_distance, loop_relax

from motionlake import spec

CANON = np.array(spec.CANONICAL_ANCHORS)


def filled(values, valid):
    """Linear in the frame number, ends held; zeros without any valid frame."""
    n = len(values)
    if not valid.any():
        return np.zeros_like(values)
    at = np.flatnonzero(valid)
    return np.stack([np.interp(np.arange(n), at, values[at, k]) for k in range(values.shape[1])], axis=1)


def window(hand, elbow, skill):
    n = len(hand)
    padded = np.concatenate([hand[[0, 0]], hand, hand[[-1, -1]]])
    smooth = np.stack([padded[i : i + 5].mean(axis=0) for i in range(n)])
    gain = np.diff(np.linalg.norm(np.diff(smooth, axis=0), axis=1))
    top = int(np.argmax(gain)) + 2 if len(gain) else 0
    low, high = max(0, top - 30), min(n - 1, top + 30)
    over = skill in ("clear", "smash")
    look = np.arange(low, high + 1 if over else high)
    peak = int(look[np.argmin(hand[look, 1] * (1 if over else -1))]) if len(look) else top
    look = np.arange(peak, (n - 1 if skill == "serve" else high) + 1)
    goal = {"serve": elbow[:, 1] - elbow[:, 0], "lift": hand[:, 1]}.get(skill, -elbow[:, 1])
    last = int(look[np.argmin(goal[look])]) if len(look) else peak
    last = min(n - 1, max(high, peak + 2) if last - peak < 2 else last)
    return max(0, peak - 30), peak, max(peak, last) if skill == "lift" else last


def normal(seq, conf, hand):
    """Body-frame coordinates of (n, 17, 3) with NaN where unseen, and the mirrored mask."""
    body = np.stack([filled(seq[:, j], (conf[:, j] > 0) & ~np.isnan(seq[:, j]).any(axis=1)) for j in range(17)], axis=1)
    if hand == "left":
        order = list(range(17))
        for a, b in spec.LEFT_RIGHT_PAIRS:
            order[a], order[b] = b, a
        body, conf = body[:, order], conf[:, order]
    axes = np.eye(3)
    for pose in body:
        across = pose[6] - pose[5]
        up = (pose[5] + pose[6]) / 2 - (pose[11] + pose[12]) / 2
        w = np.linalg.norm(across)
        if w < 1e-8:
            continue
        x = across / w
        y = up - (up @ x) * x
        if np.linalg.norm(y) < 1e-8:
            continue
        y = y / np.linalg.norm(y)
        z = np.cross(x, y)
        axes = np.stack([x, y, z / max(np.linalg.norm(z), 1e-8)])
        break
    sizes = [np.linalg.norm(body[f, a] - body[f, b]) for f in range(len(body)) for a, b in spec.BONES if conf[f, a] > 0 and conf[f, b] > 0]
    sizes = [s for s in sizes if s > 1e-8]
    scale = float(np.median(sizes)) if sizes else 1.0
    pelvis = (body[:, 11:12] + body[:, 12:13]) / 2
    out = (body - pelvis) @ axes.T / scale
    if hand == "left":
        out[..., 2] *= -1
    return out, conf


def at_frames(values, frames):
    """Linear values of a dense axis at fractional frames."""
    low = np.clip(np.floor(frames).astype(int), 0, len(values) - 1)
    high = np.minimum(low + 1, len(values) - 1)
    w = (frames - low).reshape(-1, *[1] * (values.ndim - 1))
    return values[low] + (values[high] - values[low]) * w


def warped(values, source, target):
    """The 64-frame axis mapped so that the knots ``source`` land on ``target``."""
    return at_frames(values, np.interp(np.arange(64), target, source))


def prepare(seq3, seq2, skill, hand):
    """The extraction of one recording with a known hand; missing joints are NaN."""
    n = len(seq2)
    out = {"n": n, "start": -1, "peak": -1, "end": -1, "ratio": 1.0, "error": ""}
    if n < 5:
        return out | {"error": "fewer than five tracked frames"}
    seen2 = (~np.isnan(seq2).any(axis=2)).astype(float)
    seen3 = (~np.isnan(seq3).any(axis=2)).astype(float)
    wrist, elbow = (9, 7) if hand == "left" else (10, 8)
    if seen2[:, wrist].sum() < 2 or seen2[:, elbow].sum() < 2:
        return out | {"error": "dominant wrist or elbow tracking is insufficient"}
    start, peak, end = window(filled(seq2[:, wrist], seen2[:, wrist] > 0), filled(seq2[:, elbow], seen2[:, elbow] > 0), skill)
    start = max(0, min(n - 1, start))
    peak = max(start, min(n - 1, peak))
    end = max(peak, min(n - 1, end))
    out |= {"start": start, "peak": peak, "end": end}
    if end - start < 4:
        return out | {"error": "analysis window is too short"}
    conf = np.minimum(seen2, seen3)[start : end + 1]
    out["ratio"] = 1 - conf.mean()
    for j in spec.LEAN_JOINTS:
        if not conf[:, j].any():
            return out | {"error": f"critical torso joint {j} is missing for the full window"}
    knots = np.array([start, (start + peak) // 2, peak, (peak + end) // 2, end])
    anchors = np.clip(np.rint((knots - start) * 63 / (end - start)), 0, 63).astype(int)
    if (np.diff(anchors) <= 0).any():
        return out | {"error": "phase anchors are not strictly increasing"}
    body, mask = normal(seq3[start : end + 1], conf, hand)
    frames = np.linspace(0, end - start, 64)
    return out | {"p": at_frames(body, frames), "c": at_frames(mask, frames), "anchors": anchors}


def nearest(source, conf, experts, skill, transition=True):
    """(distance, id, relaxed pose, confidence) of the best of [(id, seq, conf)]."""
    found = []
    for i, seq, c in experts:
        moved = loop_relax(source, seq)
        found.append((loop_distance(source, moved, conf * c, skill, transition), i, moved, c))
    return min(found, key=lambda f: f[:2])


def euclidean(source, conf, experts):
    """Masked mean joint distances to [(id, seq, conf)]."""
    out = []
    for i, seq, c in experts:
        mask = conf * c
        out.append((float((np.linalg.norm(source - seq, axis=-1) * mask).sum() / mask.sum()), i))
    return sorted(out)


def correct(p, c, anchors, skill, bank, guidance=0.5, strength=1.0):
    """Corrected pose of a clip on its own timing; ``bank`` is aligned."""
    s, conf = warped(p, anchors, CANON), warped(c, anchors, CANON)
    _, expert, target, _ = nearest(s, conf, bank, skill)
    mixed = s + strength * ((1 - guidance) * s + guidance * target - s)
    delta = warped(loop_relax(s, mixed) - s, CANON, anchors)
    return loop_relax(p, p + delta), expert


def score(distance, offset, alpha):
    return 100 * math.exp(-alpha * max(distance - offset, 0.0))
