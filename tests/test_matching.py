"""Kernels and matching against plain NumPy loops on a small pose fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions import kernels
from motionlake.operators import distance as D
from motionlake.operators import grading as G
from motionlake.operators import matching as M
from motionlake.operators import pose as P
from motionlake.operators import sampling as S

T_ = 64
BASE = np.array([
    [0, 2.2, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [-0.5, 1.6, 0], [0.5, 1.6, 0.1], [-0.8, 1.1, 0.1], [0.9, 1.2, 0.2],
    [-0.9, 0.7, 0.3], [1.1, 0.9, 0.4], [-0.3, 0.6, 0], [0.3, 0.6, 0], [-0.35, 0.0, 0.1], [0.35, 0.0, 0.1], [-0.35, -0.6, 0], [0.35, -0.6, 0],
])


def clip(shift=0.0, joint=10, seed=None):
    seq = np.repeat(BASE[None], T_, 0)
    seq[:, 10, 1] += np.linspace(0, 0.7, T_)
    seq[:, joint, 0] += shift
    if seed is not None:
        seq = seq + np.random.default_rng(seed).normal(scale=0.02, size=seq.shape)
    return seq


def frames(spark, clips):
    """clips: (id, skill, hand, label, seq, conf)"""
    rows = []
    for i, skill, hand, label, seq, conf in clips:
        for f in range(len(seq)):
            rows.append((i, skill, hand, label, f, seq[f].ravel().tolist(), conf[f].tolist()))
    return spark.createDataFrame(rows, "clip_id int, skill string, handedness string, label string, frame int, p array<double>, c array<double>")


@pytest.fixture(scope="module")
def bank(spark):
    ones = np.ones((T_, 17))
    rng = np.random.default_rng(5)
    clips, i = [], 0
    for skill in ("clear", "serve"):
        for hand in ("right", "left"):
            for k in range(5):
                conf = (rng.random((T_, 17)) > 0.1).astype(float) if k % 2 else ones
                clips.append((i, skill, hand, "experts", clip(0.1 * k, 8 + k % 3, seed=i), conf))
                i += 1
    for k, (skill, hand) in enumerate((("clear", "right"), ("serve", "right"), ("serve", "left"))):
        conf = (rng.random((T_, 17)) > 0.2).astype(float)
        clips.append((100 + k, skill, hand, "beginners", clip(0.17 + 0.1 * k, 10, seed=100 + k), conf))
    return clips, frames(spark, clips).cache()


def loop_relax(source, target, iterations=20):
    out = target.copy()
    for f in range(len(out)):
        want = [np.linalg.norm(source[f, b] - source[f, a]) for a, b in spec.BONES]
        root = (source[f, 11] + source[f, 12]) / 2
        for _ in range(iterations):
            for w, (a, b) in zip(want, spec.BONES):
                v = out[f, b] - out[f, a]
                n = np.linalg.norm(v)
                if n > 1e-8:
                    step = 0.5 * (n - w) / n * v
                    out[f, a] += step
                    out[f, b] -= step
            out[f] += root - (out[f, 11] + out[f, 12]) / 2
    return out


def loop_distance(source, target, mask, skill, transition=True):
    def mean(v, m):
        return 0.0 if m.sum() < 1e-8 else float((v * m).sum() / m.sum())

    def angle(p, a, b, c):
        u, v = p[a] - p[b], p[c] - p[b]
        n = np.linalg.norm(u) * np.linalg.norm(v)
        return math.acos(min(1.0, max(-1.0, float(u @ v) / n if n > 1e-8 else 1.0)))

    w = np.array(spec.JOINT_WEIGHTS[skill])
    pos = mean(np.linalg.norm(source - target, axis=-1), mask * w)
    vel = mean(np.linalg.norm(np.diff(source - target, axis=0), axis=-1), mask[1:] * mask[:-1] * w)
    bones = np.array([[abs(np.linalg.norm(s[a] - s[b]) - np.linalg.norm(t[a] - t[b])) for a, b in spec.BONES] for s, t in zip(source, target)])
    bmask = np.array([[m[a] * m[b] for a, b in spec.BONES] for m in mask])
    angles = np.array([[abs(angle(s, *q) - angle(t, *q)) / math.pi for q in spec.ANGLE_TRIPLETS] for s, t in zip(source, target)])
    amask = np.array([[m[a] * m[b] * m[c] for a, b, c in spec.ANGLE_TRIPLETS] for m in mask])
    total = pos + 0.5 * mean(angles, amask) + 0.5 * vel + 0.25 * mean(bones, bmask)
    if skill == "serve" and transition:
        j = list(spec.TRANSITION_JOINTS)
        d = (source - source[:1])[:, j] - (target - target[:1])[:, j]
        e, m = np.linalg.norm(d, axis=-1), mask[:, j] * mask[:1, j]
        lower = 0.5 * mean(e, m) + 0.5 * mean(e[-1], m[-1])
        axis = lambda p: ((p[:, 5] + p[:, 6]) - (p[:, 11] + p[:, 12])) / 2
        lean = lambda p: np.arctan2(axis(p)[:, 2], axis(p)[:, 1])
        ls, lt = lean(source), lean(target)
        e = np.abs((ls - ls[0]) - (lt - lt[0]))
        m = mask[:, [5, 6, 11, 12]].prod(1) * mask[0, [5, 6, 11, 12]].prod()
        total += 0.65 * lower + 0.35 * (0.5 * mean(e, m) + 0.5 * mean(e[-1:], m[-1:]))
    return total


def test_bone_relaxation_equals_the_loop_and_converges():
    source, target = clip(seed=1), clip(0.3, 8, seed=2)
    got = kernels.relax_bones(source[:6], target[:6], 20)
    np.testing.assert_allclose(got, loop_relax(source[:6], target[:6]), atol=1e-9)
    moved = kernels.relax_bones(source, source + 0.05, 20)
    ends = np.array(spec.BONES)
    length = lambda p: np.linalg.norm(p[:, ends[:, 0]] - p[:, ends[:, 1]], axis=-1)
    assert np.quantile(np.abs(length(moved) - length(source)), 0.95) < 1e-3
    np.testing.assert_allclose(moved[:, 11] + moved[:, 12], source[:, 11] + source[:, 12], atol=1e-9)


def test_match_equals_brute_force_within_skill_and_hand(spark, bank):
    clips, df = bank
    students, experts = df.where("label = 'beginners'"), df.where("label = 'experts'")
    got = {r.clip_id: r for r in M.match_expert(students, experts).collect()}
    for i, skill, hand, label, seq, conf in clips:
        if label != "beginners":
            continue
        found = []
        for j, s2, h2, l2, seq2, conf2 in clips:
            if l2 == "experts" and (s2, h2) == (skill, hand):
                found.append((loop_distance(seq, loop_relax(seq, seq2), conf * conf2, skill), j))
        best = min(found)
        assert got[i].expert_id == best[1]
        assert got[i].distance == pytest.approx(best[0], abs=1e-9)
        assert got[i].experts == len(found)


def test_salted_path_gives_the_same_matches(spark, bank, monkeypatch):
    _, df = bank
    students, experts = df.where("label = 'beginners'"), df.where("label = 'experts'")
    near = lambda: sorted((r.clip_id, r.expert_id, round(r.distance, 9)) for r in M.match_expert(students, experts).collect())
    plain = near()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "CHUNK", 2)
    assert near() == plain


def test_catalyst_distance_equals_the_kernel(spark, bank):
    clips, df = bank
    students, experts = df.where("label = 'beginners'"), df.where("label = 'experts'")
    matches = M.match_expert(students, experts)
    pairs = M.adapt_bone_lengths(M.with_expert(students, experts, matches))
    got = {r.clip_id: r.correction_distance for r in D.correction_distance(pairs).collect()}
    want = {r.clip_id: r.distance for r in matches.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_opposite_hand_is_never_used(spark, bank):
    _, df = bank
    students = df.where("label = 'beginners' AND handedness = 'left'")
    right = df.where("label = 'experts' AND handedness = 'right'")
    assert M.match_expert(students, right).count() == 0
    assert M.without_expert(students, right).count() == 1


def test_identity_and_full_guidance(spark, bank):
    _, df = bank
    anchors = F.array(*[F.lit(a) for a in spec.CANONICAL_ANCHORS])
    students = df.where("label = 'beginners' AND skill = 'clear'").withColumn("anchors", anchors)
    experts = df.where("label = 'experts'").withColumn("anchors", anchors)
    still = M.correct_clips(students, experts, guidance=0.0).selectExpr("aggregate(zip_with(s, t, (a, b) -> abs(a - b)), 0D, (a, v) -> greatest(a, v)) d").agg(F.max("d")).first()[0]
    assert still < 1e-5
    full = M.correct_clips(students, experts, guidance=1.0)
    matches = M.match_expert(students, experts)
    target = M.adapt_bone_lengths(M.with_expert(students, experts, matches)).select("clip_id", "frame", F.col("t").alias("w"))
    gap = full.join(target, ["clip_id", "frame"]).selectExpr("aggregate(zip_with(t, w, (a, b) -> abs(a - b)), 0D, (a, v) -> greatest(a, v)) d").agg(F.max("d")).first()[0]
    assert gap < 1e-3


def test_left_clip_normalises_like_its_mirror(spark):
    seq = clip(seed=3)
    mirrored = seq.copy()
    for a, b in spec.LEFT_RIGHT_PAIRS:
        mirrored[:, [a, b]] = mirrored[:, [b, a]]
    mirrored[..., 0] *= -1
    ones = np.ones((T_, 17))
    df = P.unpack(frames(spark, [(1, "clear", "right", "x", seq, ones), (2, "clear", "left", "x", mirrored, ones)]))
    out = P.normalize_pose(df)
    rows = {(r.clip_id, r.frame): r.p for r in out.collect()}
    for f in range(T_):
        np.testing.assert_allclose(rows[1, f], rows[2, f], atol=1e-9)


def test_distance_is_zero_for_equal_clips_and_grows(spark):
    ones = np.ones((T_, 17))
    source = frames(spark, [(i, "clear", "right", "x", clip(), ones) for i in range(3)])
    target = frames(spark, [(i, "clear", "right", "x", clip(0.2 * i), ones) for i in range(3)])
    got = [r.correction_distance for r in D.correction_distance(D.pairs(source, target)).orderBy("clip_id").collect()]
    assert got[0] == 0.0 and got[0] < got[1] < got[2]


def test_wrist_error_is_credited_to_the_wrist(spark):
    ones = np.ones((T_, 17))
    pairs = D.pairs(frames(spark, [(0, "clear", "right", "x", clip(), ones)]), frames(spark, [(0, "clear", "right", "x", clip(0.4, 10), ones)]))
    rows = {r.joint: r.correction_distance for r in D.keypoint_components(D.frame_terms(pairs)).collect()}
    assert max(rows, key=rows.get) == 10


def test_calibration_separates_cohorts(spark):
    rows = [("clear", "experts", d) for d in (0.01, 0.012, 0.014, 0.016)] + [("clear", "beginners", d) for d in (0.08, 0.09, 0.10, 0.11)]
    df = spark.createDataFrame(rows, "skill string, label string, correction_distance double")
    fitted = G.fit_calibration(df)
    assert fitted.first().target_reachable
    means = {r.label: r.m for r in G.with_scores(df, fitted).groupBy("label").agg(F.avg("total_grade").alias("m")).collect()}
    assert 98 <= means["experts"] <= 100 and means["beginners"] == pytest.approx(45, abs=1e-6)
    low = spark.createDataFrame([("clear", "experts", 0.5), ("clear", "beginners", 0.1)], "skill string, label string, correction_distance double")
    assert not G.fit_calibration(low.withColumn("correction_distance", F.col("correction_distance") - 0.6)).first().target_reachable


def test_criteria_sum_to_the_total(spark):
    ones = np.ones((T_, 17))
    pairs = D.pairs(frames(spark, [(k, s, "right", "x", clip(), ones) for k, s in enumerate(spec.SKILLS)]), frames(spark, [(k, s, "right", "x", clip(0.3, 10), ones) for k, s in enumerate(spec.SKILLS)]))
    calibration = spark.createDataFrame([(s, 0.01, 4.0) for s in spec.SKILLS], "skill string, distance_offset double, alpha double")
    totals, criteria = G.grade_clips(pairs, calibration)
    sums = criteria.groupBy("clip_id").agg(F.sum("grade").alias("g")).join(totals.select("clip_id", "total_grade"), "clip_id")
    for r in sums.collect():
        assert r.g == pytest.approx(r.total_grade, abs=1e-6)


def test_contract_is_intact(spark):
    assert spec.contract_violations(spark).count() == 0


def test_splits_hold_both_hands(spark):
    rows = [(i, "left" if i < 9 else "right") for i in range(19)]
    out = S.split(spark.createDataFrame(rows, "clip_id int, handedness string"), 3, stratify=["handedness"])
    found = {(r.split, r.handedness) for r in out.collect()}
    assert found == {(s, h) for s in ("training", "validation", "test") for h in ("left", "right")}
    assert out.count() == 19


def test_warping_path_equals_the_table():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(13, 2)).round(1), rng.normal(size=(9, 2)).round(1)
    cost = np.full((14, 10), np.inf)
    cost[0, 0] = 0
    for i in range(1, 14):
        for j in range(1, 10):
            cost[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    path, total = kernels.warping_path(a, b)
    assert total == pytest.approx(cost[-1, -1])
    assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (12, 8)
    assert sum(np.linalg.norm(a[i] - b[j]) for i, j in path) == pytest.approx(total)


def test_overlay_recovers_an_affine_camera(spark):
    seq = clip(seed=9)[:4]
    rows = []
    for f in range(4):
        px = np.stack([100 * seq[f, :, 0] + 10 * seq[f, :, 2] + 3, 50 * seq[f, :, 1] - 7], 1)
        conf = np.ones(17) if f < 3 else np.r_[np.ones(2), np.zeros(15)]
        rows.append((0, f, seq[f].ravel().tolist(), (seq[f] + 0.1).ravel().tolist(), px.ravel().tolist(), conf.tolist()))
    df = spark.createDataFrame(rows, "clip_id int, frame int, s array<double>, t array<double>, px array<double>, c array<double>")
    got = {r.frame: r for r in M.overlay_coordinates(df).collect()}
    want = np.array(rows[0][4]).reshape(17, 2) + np.array([100 * 0.1 + 10 * 0.1, 50 * 0.1])
    np.testing.assert_allclose(np.array(got[0].pixels).reshape(17, 2), want, atol=1e-6)
    assert got[3].pixels is None and got[3].error


def test_predicted_pose_plugs_in(spark, bank):
    """A model is any table function that adds ``m``; here it shifts every joint up."""
    _, df = bank
    anchors = F.array(*[F.lit(a) for a in spec.CANONICAL_ANCHORS])
    students = df.where("label = 'beginners' AND skill = 'clear'").withColumn("anchors", anchors)
    experts = df.where("label = 'experts'").withColumn("anchors", anchors)

    def model(table):
        def run(batches):
            for batch in batches:
                yield batch.assign(m=[np.asarray(s) + np.tile([0.3, 0.0, 0.0], 17) for s in batch["s"]])

        schema = ", ".join(f"{n} {t}" for n, t in table.dtypes) + ", m array<double>"
        return table.mapInPandas(run, schema)

    out = M.correct_clips(students, experts, model=model, guidance=0.0)
    row = out.selectExpr("abs(t[30] - s[30]) + abs(t[33] + t[36] - s[33] - s[36]) d").agg(F.max("d")).first()
    # bone lengths and the pelvis belong to the student, so a pure shift is undone
    assert row[0] < 1e-6


def test_training_pairs_point_experts_at_themselves(spark, bank):
    _, df = bank
    out = M.build_training_pairs(df.where("label = 'beginners'"), df.where("label = 'experts'"))
    assert out.select("clip_id").distinct().count() == 23
    assert out.where("size(features) <> 119").count() == 0
    own = out.where("clip_id = expert_id")
    assert own.select("clip_id").distinct().count() == 20
    assert own.where("s <> t").count() == 0


def test_bones_side_by_side_equal_one_after_the_other():
    """Left and right bones that go together, and one clip against many, give the plain sweep."""
    rng = np.random.default_rng(11)
    source, targets = rng.normal(size=(T_, 17, 3)), rng.normal(size=(3, T_, 17, 3))
    targets[1, 5, 7] = targets[1, 5, 5]  # a bone without length
    moved = kernels.relax_to(kernels.joints_first(source[None]), kernels.joints_first(targets), 20)
    for e in range(3):
        assert np.allclose(np.moveaxis(moved[:, :, e], 2, 0), loop_relax(source, targets[e]), atol=1e-9)
    assert sum(w for _, _, w in kernels._BONE_STEPS) == len(spec.BONES)


def test_grid_meets_every_pair_once_with_few_copies(spark, monkeypatch):
    """Above the broadcast limit the copies follow the cores, not the number of students."""
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    row = lambda name, n: spark.range(n).select(
        F.lit("clear").alias("skill"), F.lit("left").alias("handedness"), F.lit(64).alias("frames"),
        F.col("id").alias("_part"), F.col("id").alias(name),
    )
    met = M.join_blocks(row("s", 3000), row("e", 30), 1, 4)
    assert met.count() == met.select("s", "e").distinct().count() == 3000 * 30
    assert M.grid_side(spark) <= 4  # of 8 cores


@pytest.fixture(scope="module")
def uneven(spark):
    """Many right-handed clips and few left-handed ones, of 6 and 9 frames; every student is near another expert."""
    hand = F.when(F.col("id") % 12 == 0, "left").otherwise("right")
    frame = F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 5 == 0, 8).otherwise(5)))
    at = lambda k: (F.pmod(F.xxhash64("id", "frame", F.lit(k)), F.lit(1000)) / 1000.0)
    clips = spark.range(360).select("id", F.lit("clear").alias("skill"), hand.alias("handedness"), frame.alias("frame"))
    return clips.select(
        F.col("id").cast("int").alias("clip_id"), "skill", "handedness", "frame",
        F.array(*[at(k) for k in range(51)]).alias("p"), F.array(*[F.when(at(60 + j) > 0.2, 1.0).otherwise(0.0) for j in range(17)]).alias("c"),
    ).cache()


def test_cells_of_uneven_groups_give_the_same_matches(spark, uneven, monkeypatch):
    students, experts = uneven.where("clip_id >= 120"), uneven.where("clip_id < 120")
    near = lambda a, b, **how: sorted(
        (r.clip_id, r.expert_id, round(r.distance, 9), round(r.mean_distance, 9), r.experts) for r in M.match_expert_euclidean(a, b, **how).collect()
    )
    plain, others = near(students, experts), near(experts, experts, exclude_self=True)
    assert len(plain) == 240 and len(others) == 120
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "CHUNK", 4)
    monkeypatch.setattr(M, "BLOCK", 4)
    assert near(students, experts) == plain
    assert near(experts, experts, exclude_self=True) == others


def test_frames_move_once_to_cells_shared_by_pairs(spark, uneven, monkeypatch):
    """Packing and meeting are one move a side, and a small group is not copied to as many cells as a large one."""
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "CHUNK", 4)
    monkeypatch.setattr(M, "BLOCK", 4)
    students, experts = uneven.where("clip_id >= 120"), uneven.where("clip_id < 120")
    plan = M.match_expert_euclidean(students, experts)._jdf.queryExecution().executedPlan().toString()
    # one for either side and one for the winners
    assert plan.count("Exchange hashpartitioning(") == 3
    sides = {r.handedness: (r._rows, r._cols) for r in M.grid_sides(M.group_sizes(students, experts, M.GROUP)).collect()}
    assert sides["left"] == (1, 1)
    assert sides["right"][0] > sides["right"][1] > 1
    assert math.prod(sides["right"]) <= 2 * M.grid_cells(spark)
