"""Whole jobs against plain NumPy versions on small recordings."""

import json

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F
from test_clip_streams import swing
from test_matching import clip, frames, loop_distance, loop_relax

from motionlake import spec
from motionlake.operators import evaluate as E
from motionlake.operators import matching as M
from motionlake.operators import timewarp as W
from motionlake.plans import clips as PC
from motionlake.plans import evaluation as PE
from motionlake.plans import feedback as PF
from motionlake.plans import scoring as PS
from motionlake.sources import tables

SKILLS = ("clear", "serve", "lift", "smash")


def recordings():
    """id -> (3-D, 2-D, skill, hand, label): gaps, both hands, every way to fail."""
    out = {}
    for i in range(8):
        rng = np.random.default_rng(i)
        seq = swing(i, frames=46 + 2 * i)
        hand = "left" if i % 3 == 2 else "right"
        if hand == "left":
            order = list(range(17))
            for a, b in spec.LEFT_RIGHT_PAIRS:
                order[a], order[b] = b, a
            seq = seq[:, order] * [-1, 1, 1]
        flat = seq[..., :2] * [100, -100] + 300
        flat = np.where(rng.random((len(seq), 17, 1)) < 0.08, np.nan, flat)
        seq = np.where(rng.random((len(seq), 17, 1)) < 0.08, np.nan, seq)
        seq[-1], flat[-1] = swing(i)[0], 300.0  # the last frame is seen
        out[i] = (seq, flat, SKILLS[i % 4], hand, "experts" if i < 4 else "beginners")
    base = swing(20)
    flat = base[..., :2] * [100, -100] + 300
    out[20] = (base[:3], flat[:3], "clear", "right", "beginners")
    lost = flat.copy()
    lost[:, 10] = np.nan
    out[21] = (base, lost, "clear", "right", "beginners")
    bent = flat.copy()
    bent[3:, 8] = np.nan
    bent[1:3, 8] = np.nan
    out[24] = (base, bent, "clear", "right", "beginners")
    torso = base.copy()
    torso[:, 11] = np.nan
    out[22] = (torso, flat, "lift", "right", "beginners")
    out[23] = (base[:5], flat[:5], "smash", "right", "beginners")
    return out


RECORDINGS = recordings()
EXPECTED = {i: plain.prepare(r[0], r[1], r[2], r[3]) for i, r in RECORDINGS.items()}


@pytest.fixture(scope="module")
def job(spark):
    three, two, meta = [], [], []
    for i, (seq, flat, skill, hand, label) in RECORDINGS.items():
        for f in range(len(seq)):
            for j in range(17):
                if not np.isnan(seq[f, j]).any():
                    three.append((i, f, j, *map(float, seq[f, j])))
                if not np.isnan(flat[f, j]).any():
                    two.append((i, f, j, *map(float, flat[f, j])))
        meta.append((i, skill, label, f"v/clip_{i}.mp4", 30.0, hand))
    sequence, summary = PC.prepare_clips(
        spark.createDataFrame(three, "clip_id int, frame int, joint int, x double, y double, z double"),
        spark.createDataFrame(two, "clip_id int, frame int, joint int, x double, y double"),
        spark.createDataFrame(meta, "clip_id int, skill string, label string, filename string, fps double, known_handedness string"),
    )
    return sequence.cache(), summary.cache()


def poses(df, value="p"):
    out = {}
    for r in df.collect():
        out.setdefault(r.clip_id, {})[r.frame] = r[value]
    return {k: np.array([v[f] for f in sorted(v)]) for k, v in out.items()}


def test_prepared_clips_equal_numpy(job):
    sequence, _ = job
    p, c = poses(sequence), poses(sequence, "c")
    anchors = {r.clip_id: list(r.anchors) for r in sequence.select("clip_id", "anchors").distinct().collect()}
    good = {i: e for i, e in EXPECTED.items() if not e["error"]}
    assert p.keys() == good.keys() and len(good) == 8
    for i, e in good.items():
        np.testing.assert_allclose(p[i].reshape(64, 17, 3), e["p"], atol=1e-7)
        np.testing.assert_allclose(c[i], e["c"], atol=1e-9)
        assert anchors[i] == e["anchors"].tolist()


def test_extraction_summary_has_every_recording_and_error(job):
    _, summary = job
    rows = {r.clip_id: r for r in summary.collect()}
    assert rows.keys() == EXPECTED.keys()
    for i, e in EXPECTED.items():
        r = rows[i]
        assert r.error == e["error"] and r.status == ("error" if e["error"] else "success")
        assert r.raw_tracked_frames == e["n"] and r.resampled_frames == (0 if e["error"] else 64)
        if not e["error"]:
            assert (r.analysis_start, r.analysis_peak, r.analysis_end) == (e["start"], e["peak"], e["end"])
            assert r.missing_joint_ratio == pytest.approx(e["ratio"]) and r.handedness == RECORDINGS[i][3]
    assert len({r.error for r in rows.values()}) >= 4


def bank_of(ids, skill, hand):
    out = []
    for i in ids:
        if RECORDINGS[i][2:4] == (skill, hand):
            e = EXPECTED[i]
            out.append((i, plain.warped(e["p"], e["anchors"], plain.CANON), plain.warped(e["c"], e["anchors"], plain.CANON)))
    return out


CALIBRATION = [(s, 0.02 * k, 2.0 + k) for k, s in enumerate(SKILLS)]


def test_batch_grades_equal_numpy(spark, job):
    """Every recording has a row: graded, failed in extraction, or without an expert."""
    sequence, summary = job
    calibration = spark.createDataFrame(CALIBRATION, "skill string, distance_offset double, alpha double")
    params = {s: (o, a) for s, o, a in CALIBRATION}
    experts = (0, 1, 2, 4, 6)
    out = PS.grade_batch(sequence, summary, sequence.where(F.col("clip_id").isin(*experts)), calibration, 0.4)
    rows = {r.clip_id: r for r in out.collect()}
    assert rows.keys() == EXPECTED.keys()
    seen = set()
    for i, e in EXPECTED.items():
        r, (skill, hand) = rows[i], RECORDINGS[i][2:4]
        bank = [] if e["error"] else bank_of(experts, skill, hand)
        if e["error"] or not bank:
            assert r.status == "error" and r.total_grade == 0 and (r.start_frame, r.peak_frame, r.end_frame) == (-1, -1, -1)
            assert r.error == (e["error"] or "no same-handed expert is available")
            seen.add(r.error)
            continue
        moved, _ = plain.correct(e["p"], e["c"], e["anchors"], skill, bank, 0.4)
        distance = loop_distance(e["p"], moved, e["c"], skill)
        assert r.correction_distance == pytest.approx(distance, abs=1e-7)
        assert r.total_grade == pytest.approx(plain.score(distance, *params[skill]), abs=1e-5)
        assert (r.start_frame, r.peak_frame, r.end_frame) == (e["start"], e["peak"], e["end"]) and r.status == "success"
        seen.add("graded")
    assert {"graded", "no same-handed expert is available"} <= seen


# --- clips that are already anchored ------------------------------------------------


ANCHORS = {0: [0, 10, 30, 50, 63], 1: [0, 16, 32, 48, 63], 2: [0, 20, 25, 40, 63]}


@pytest.fixture(scope="module")
def anchored(spark):
    rng = np.random.default_rng(11)
    clips = []
    for i in range(9):
        skill = ("clear", "serve")[i % 2]
        conf = (rng.random((64, 17)) > 0.1).astype(float)
        label = "experts" if i < 6 else "beginners"
        clips.append((i, skill, "right", label, clip(0.06 * i, 8 + i % 3, seed=i), conf))
    clips.append((9, "clear", "left", "beginners", clip(seed=9), np.ones((64, 17))))
    table = frames(spark, clips)
    knots = F.when(F.col("clip_id") % 3 == 0, F.array(*map(F.lit, ANCHORS[0]))).when(F.col("clip_id") % 3 == 1, F.array(*map(F.lit, ANCHORS[1]))).otherwise(F.array(*map(F.lit, ANCHORS[2])))
    table = table.withColumn("anchors", knots).withColumn("split", F.when(F.col("clip_id") % 4 == 1, "test").otherwise("training"))
    return clips, table.withColumn("filename", F.concat(F.lit("f"), F.col("clip_id").cast("string"), F.lit(".mp4"))).cache()


def aligned_of(clips, skill, hand, ids=None):
    return [
        (i, plain.warped(seq, ANCHORS[i % 3], plain.CANON), plain.warped(conf, ANCHORS[i % 3], plain.CANON))
        for i, s, h, _, seq, conf in clips
        if (s, h) == (skill, hand) and (ids is None or i in ids)
    ]


def test_score_report_and_its_files(spark, anchored, tmp_path):
    clips, table = anchored
    calibration = spark.createDataFrame([("clear", 0.01, 3.0), ("serve", 0.02, 2.0)], "skill string, distance_offset double, alpha double")
    params = {"clear": (0.01, 3.0), "serve": (0.02, 2.0)}
    old = spark.createDataFrame([("f0.mp4", "experts", 50.0), ("f6.mp4", "beginners", 20.0), ("f6.mp4", "experts", 1.0)], "filename string, label string, total_grade double")
    report = PS.score_report(table, table.where("label = 'experts'"), guidance=0.7, calibration=calibration, old=old)
    grades = {r.clip_id: r for r in report.grades.collect()}
    assert grades.keys() == set(range(9))
    assert [(r.clip_id, r.error) for r in report.errors.collect()] == [(9, "no same-handed expert is available")]
    for i, skill, hand, label, seq, conf in clips[:9]:
        bank = aligned_of(clips, skill, hand, range(6))
        moved, _ = plain.correct(seq, conf, ANCHORS[i % 3], skill, bank, 0.7)
        want = loop_distance(seq, moved, conf, skill)
        assert grades[i].correction_distance == pytest.approx(want, abs=1e-8)
        assert grades[i].total_grade == pytest.approx(plain.score(want, *params[skill]), abs=1e-6)
    changes = {(r.filename, r.label): r for r in report.changes.collect()}
    assert len(changes) == 9 and changes["f1.mp4", "experts"].score_delta is None
    assert changes["f6.mp4", "beginners"].score_delta == pytest.approx(grades[6].total_grade - 20)
    sums = report.criteria.groupBy("clip_id").agg(F.sum("grade").alias("g")).collect()
    assert all(r.g == pytest.approx(grades[r.clip_id].total_grade, abs=1e-6) for r in sums) and len(sums) == 9
    paths = PS.write_report(report, str(tmp_path))
    wide = tables.read_grades(spark, paths["grades"], ["clip_id", "total_grade", "detail_1_grade", "keypoint_dominant_wrist_score"])
    assert {int(r.clip_id): round(float(r.total_grade), 6) for r in wide.collect()} == {i: round(g.total_grade, 6) for i, g in grades.items()}
    advice = {json.loads(r.document)["filename"]: json.loads(r.document) for r in tables.read_documents(spark, paths["advice"]).collect()}
    assert len(advice) == 9 and len(advice["f0.mp4"]["keypoints"]) == 13 and len(advice["f0.mp4"]["priority_corrections"]) == 5
    assert {r.skill for r in tables.read_calibration(spark, paths["calibration"]).collect()} == {"clear", "serve"}
    assert spark.read.csv(paths["compact"], header=True).count() == 9 and spark.read.csv(paths["changes"], header=True).count() == 9
    assert spark.read.csv(paths["errors"], header=True).count() == 1 and spark.read.csv(paths["summary"], header=True).count() > 0
    plain_report = PS.score_report(table, table.where("label = 'experts'"), calibration=calibration)
    assert plain_report.changes is None and "changes" not in PS.write_report(plain_report, str(tmp_path / "again"))


def test_audit_equals_numpy_and_passes_the_gate(spark, anchored):
    clips, table = anchored
    train, fresh = table.where("clip_id IN (0, 1, 2, 3)"), table.where("clip_id IN (4, 5)")
    students = table.where("label = 'beginners' AND handedness = 'right'")
    rows, summary = PE.audit_corrections(students, train, fresh, 0.2, guidance=0.6)
    got = {r.clip_id: r for r in rows.collect()}
    assert got.keys() == {6, 7, 8}
    for i, skill, hand, _, seq, conf in clips[6:9]:
        s, c = plain.warped(seq, ANCHORS[i % 3], plain.CANON), plain.warped(conf, ANCHORS[i % 3], plain.CANON)
        bank, unseen = aligned_of(clips, skill, hand, (0, 1, 2, 3)), aligned_of(clips, skill, hand, (4, 5))
        _, expert, target, _ = plain.nearest(s, c, bank, skill)
        moved = loop_relax(s, 0.4 * s + 0.6 * target)
        before, after = plain.euclidean(s, c, bank + unseen), plain.euclidean(moved, c, bank + unseen)
        r = got[i]
        assert r.correction_reference_expert == expert
        assert r.input_nearest_expert_distance == pytest.approx(before[0][0], abs=1e-8) and r.input_nearest_expert == before[0][1]
        assert r.corrected_nearest_expert_distance == pytest.approx(after[0][0], abs=1e-8) and r.corrected_nearest_expert == after[0][1]
        assert r.corrected_mean_expert_distance == pytest.approx(np.mean([d for d, _ in after]), abs=1e-8)
        assert r.corrected_nearest_unseen_expert_distance == pytest.approx(plain.euclidean(moved, c, unseen)[0][0], abs=1e-8)
        assert r.within_expert_range == (after[0][0] <= 0.2)
        assert r.nearest_distance_improvement == pytest.approx(before[0][0] - after[0][0], abs=1e-8)
    limits = E.GATE
    per_skill = {r.skill: r for r in summary.collect()}
    for skill, members in (("clear", (6, 8)), ("serve", (7,))):
        r, of = per_skill[skill], [got[m] for m in members]
        near = [x.corrected_nearest_expert_distance for x in of]
        assert r["count"] == len(of) and r.corrected_nearest_expert_distance == pytest.approx(np.mean(near))
        improved = np.mean([x.corrected_nearest_expert_distance < x.input_nearest_expert_distance for x in of])
        ok = (
            improved >= limits["improved_fraction"] and all(d <= 0.2 for d in near)
            and max(x.corrected_reference_target_distance for x in of) <= limits["max_reference_target_distance"]
            and max(x.max_joint_correction for x in of) <= limits["max_correction"] * 1.5
            and np.mean([x.correction_acceleration_ratio for x in of]) <= limits["acceleration_ratio"]
            and max(x.p95_relative_bone_change for x in of) < limits["bone_change"]
        )
        assert r.accepted == ok and r.expert_p95 == 0.2 and isinstance(r.safe, bool)


def test_the_gate_says_no_and_yes(spark):
    good = {"improved_fraction": 1.0, "within_expert_range_fraction": 1.0, "corrected_nearest_expert_distance": 0.1, "max_reference_target_distance": 0.05,
            "max_joint_correction": 0.5, "mean_correction_acceleration_ratio": 1.0, "p95_relative_bone_change": 0.0}
    bad = {"a": {}, "b": {"improved_fraction": 0.9}, "c": {"max_joint_correction": 1.3}, "d": {"corrected_nearest_expert_distance": 0.3}, "e": {"p95_relative_bone_change": 0.001}}
    rows = [{"skill": k, **good, **v} for k, v in bad.items()]
    out = {r.skill: (r.accepted, r.safe) for r in PE.gated(spark.createDataFrame(rows), 0.2).collect()}
    assert out == {"a": (True, True), "b": (False, True), "c": (False, False), "d": (False, True), "e": (False, False)}


def test_shadow_grading_equals_numpy(spark, anchored):
    """Two sources of the same clips; experts are graded against the other experts."""
    clips, table = anchored
    base = W.phase_align(table.where("handedness = 'right'").drop("split")).select("clip_id", "frame", "p", "c", "skill", "label")
    one = base.withColumns({"candidate": F.lit("oracle"), "subject": F.col("clip_id")})
    two = base.withColumns({"candidate": F.lit("wide"), "subject": F.col("clip_id"), "clip_id": F.col("clip_id") + 100, "p": F.expr("transform(p, v -> v * 1.1D)")})
    scored, criteria, calibration = PE.shadow_grading(one.unionByName(two), calibration_clips=1)
    rows = {r.clip_id: r for r in scored.collect()}
    assert rows.keys() == set(range(9)) | set(range(100, 109))
    for skill in ("clear", "serve"):
        members = aligned_of(clips, skill, "right")
        for scale, shift in ((1.0, 0), (1.1, 100)):
            bank = [(i, seq * scale, c) for i, seq, c in members if i < 6]
            for i, seq, c in members:
                others = [b for b in bank if b[0] != i]
                best = plain.nearest(seq * scale, c, others, skill, transition=False)
                r = rows[i + shift]
                assert r.raw_score_distance == pytest.approx(best[0], abs=1e-8)
                first = min(m for m, _, _ in members if m >= 6)
                assert r.split == ("calibration" if i == first else "expert_cross_validation" if i < 6 else "test")
    fitted = {r.cohort: (r.distance_offset, r.alpha) for r in calibration.collect()}
    assert len(fitted) == 4
    for r in rows.values():
        assert r.total_score == pytest.approx(plain.score(r.raw_score_distance, *fitted[r.cohort]), abs=1e-9)
    compared = {r.clip_id: r for r in PE.against_oracle(scored, criteria, "oracle").collect()}
    grades = {}
    for r in criteria.collect():
        grades.setdefault(r.clip_id, {})[r.k] = r.grade
    for i in range(9):
        assert compared[i].criterion_score_mae == 0 and compared[100 + i].oracle_total_score == rows[i].total_score
        mae = np.mean([abs(grades[100 + i][k] - grades[i][k]) for k in grades[i]])
        assert compared[100 + i].criterion_score_mae == pytest.approx(mae)


def test_feedback_dataset_checks_and_exports(spark, anchored):
    clips, table = anchored
    calibration = spark.createDataFrame([("clear", 0.01, 3.0), ("serve", 0.02, 2.0)], "skill string, distance_offset double, alpha double")
    report = PS.score_report(table, table.where("label = 'experts'"), calibration=calibration)
    info = table.select("clip_id", "skill", "handedness", "filename", "anchors").distinct()
    source = F.sequence(F.lit(100), F.lit(163))
    shown = info.join(report.grades.select("clip_id", "total_grade"), "clip_id").withColumns({"source_frame_indices": source, "fps": F.lit(30.0)})
    rule = {s: spec.RULES[s][0] for s in SKILLS}
    text, reason = "擊球瞬間手腕發力不足，請加強前臂帶動。", "影像顯示手腕在擊球時沒有向前。"
    problems = [(6, 0, "clear", rule["clear"][0], 10, text, reason, 0.8), (7, 0, "serve", rule["serve"][0], 16, text, reason, 0.7),
                (8, 0, "clear", rule["clear"][0], 10, "", reason, 0.8), (8, 1, "clear", "no_such_rule", 10, text, reason, 0.8)]
    answers = spark.createDataFrame(problems, "clip_id int, problem int, skill string, rule_id string, frame_index int, feedback string, evidence string, confidence double")
    context, rows, bad = PF.feedback_dataset(shown, report.criteria, report.evidence, answers)
    documents = {r.clip_id: json.loads(r.context) for r in context.collect()}
    assert documents.keys() == set(range(9))
    grades = {(r.clip_id, r["name"]): r.grade for r in report.criteria.collect()}
    for i, d in documents.items():
        assert d["skill"] == clips[i][1] and d["student"]["total_grade"] == pytest.approx({r.clip_id: r.total_grade for r in report.grades.collect()}[i])
        assert len(d["lowest_keypoint_scores"]) == 8 and len(d["priority_corrections"]) == 5
    exported = {(r.clip_id, r.problem): r for r in rows.collect()}
    violations = {(r.clip_id, r.problem) for r in bad.collect()}
    assert (8, 0) in violations and not violations & exported.keys()
    assert exported.keys() <= {(6, 0), (7, 0)} and exported
    for (i, _), r in exported.items():
        assert r.criterion_score == pytest.approx(grades[i, rule[clips[i][1]][1]])


# --- contract -----------------------------------------------------------------------


def test_every_broken_contract_is_found(spark, monkeypatch):
    found = lambda: {(r.skill, r.violation) for r in spec.contract_violations(spark).collect()}
    assert found() == set()
    with monkeypatch.context() as m:
        m.setitem(spec.JOINT_WEIGHTS, "lift", spec.JOINT_WEIGHTS["lift"][:16])
        assert found() == {("lift", "needs 17 joint weights")}
    with monkeypatch.context() as m:
        m.setitem(spec.CHECKPOINT_ROLES, "smash", spec.CHECKPOINT_ROLES["smash"][:4])
        assert found() == {("smash", "needs five checkpoint roles")}
    with monkeypatch.context() as m:
        m.setattr(spec, "LEAN_JOINTS", (5, 6, 11))
        assert found() == {("serve", "transition scoring needs support joints and four torso joints")}
    with monkeypatch.context() as m:
        m.setattr(spec, "TRANSITION_JOINTS", ())
        assert found() == {("serve", "transition scoring needs support joints and four torso joints")}
    with monkeypatch.context() as m:
        rules = list(spec.RULES["clear"])
        rules[0] = (*rules[0][:3], 11.0, *rules[0][4:])
        m.setitem(spec.RULES, "clear", tuple(rules))
        assert ("clear", "rule maxima must total 100") in found() and ("clear", "criterion maxima must total 100") in found()


def test_stored_models_must_fit_their_skill(spark):
    w = {s: list(spec.JOINT_WEIGHTS[s]) for s in SKILLS}
    joints, lean = list(spec.TRANSITION_JOINTS), list(spec.LEAN_JOINTS)
    rows = [
        ("fine serve", "serve", "serve", w["serve"], 1.0, joints, lean), ("fine lift", "lift", "lift", w["lift"], None, None, None),
        ("old clear", "clear", None, None, None, None, None), ("other", "lift", "serve", w["lift"], None, None, None), ("unsaid", "lift", None, w["lift"], None, None, None),
        ("no weights", "smash", "smash", None, None, None, None), ("short", "lift", "lift", w["lift"][:16], None, None, None),
        ("changed", "lift", "lift", [*w["lift"][:16], 9.0], None, None, None), ("close", "lift", "lift", [v * (1 + 1e-7) for v in w["lift"]], 0.0, [], []),
        ("still", "serve", "serve", w["serve"], 0.0, joints, lean), ("moving", "lift", "lift", w["lift"], 1.0, joints, lean),
        ("less lean", "serve", "serve", w["serve"], 1.0, joints, lean[:3]), ("unknown", "drop", "drop", None, None, None, None),
    ]
    schema = "checkpoint string, requested_skill string, skill string, joint_weights array<double>, transition_weight double, transition_joints array<int>, transition_lean_joints array<int>"
    got = {r.checkpoint: r.violation for r in spec.checkpoint_violations(spark, spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "other": "the model is of another skill", "unsaid": "the model is of another skill", "no weights": "the model does not contain joint weights",
        "short": "joint weights do not match the contract", "changed": "joint weights do not match the contract",
        "still": "transition scoring does not match the contract", "moving": "transition scoring does not match the contract",
        "less lean": "transition scoring does not match the contract", "unknown": "the requested skill is not supported",
    }


def test_small_expert_groups_are_error_rows(spark, anchored):
    _, table = anchored
    few = W.phase_align(table.where("clip_id IN (0, 2, 4, 1)"))
    rows = {r.skill: r for r in E.expert_variability(few).collect()}
    assert rows["clear"].error == "" and rows["clear"]["count"] == 3
    near = M.match_expert_euclidean(few, few, exclude_self=True)
    assert rows["clear"].mean_nearest == pytest.approx(near.agg(F.avg("distance")).first()[0])
    assert rows["serve"].error and rows["serve"]["count"] == 0 and rows["serve"].mean_nearest is None
