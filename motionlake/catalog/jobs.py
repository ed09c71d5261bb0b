"""Queries that chain many operators, and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motionlake import spec
from motionlake.catalog.distances import BASE, TERM_SQL, pairs64
from motionlake.catalog.poses import ANCHOR_EXPR, FILL_SQL, R6, clips64
from motionlake.catalog.registry import query
from motionlake.catalog.scores import _calibrate_sql
from motionlake.catalog.views import CANDIDATE_SQL, GRADED_SQL, POSE_SQL, graded, pose_frames, pose_joints, table
from motionlake.functions.ordered import number_rows
from motionlake.operators import evaluate as E
from motionlake.operators import grading as G
from motionlake.operators import matching as M
from motionlake.operators import pose as P
from motionlake.operators import timewarp as W
from motionlake.operators import warping
from motionlake.plans import clips as PC
from motionlake.plans import evaluation as PE
from motionlake.plans import scoring as PS
from motionlake.session import scratch_folder, settle
from motionlake.sources import archives, tables

HAND_SQL = """
six AS (SELECT clip_id, joint, frame, x, y FROM fil WHERE joint IN (5,6,9,10,11,12) AND (clip_id, joint) IN (SELECT (clip_id, joint) FROM pose WHERE conf > 0.05 GROUP BY ALL HAVING count(*) >= 2)),
wd AS (SELECT clip_id, frame, max(x) FILTER (joint=5) x5, max(y) FILTER (joint=5) y5, max(x) FILTER (joint=6) x6, max(y) FILTER (joint=6) y6, max(x) FILTER (joint=9) x9, max(y) FILTER (joint=9) y9,
  max(x) FILTER (joint=10) x10, max(y) FILTER (joint=10) y10, max(x) FILTER (joint=11) x11, max(y) FILTER (joint=11) y11, max(x) FILTER (joint=12) x12, max(y) FILTER (joint=12) y12 FROM six GROUP BY 1, 2 HAVING count(*) = 6),
wi AS (SELECT *, sqrt((x6-x5)**2+(y6-y5)**2) w, (x5+x6+x11+x12)/4 cx, (y5+y6+y11+y12)/4 cy FROM wd),
wm AS (SELECT *, median(CASE WHEN w > 1e-8 THEN w END) OVER (PARTITION BY clip_id) med, count(CASE WHEN w > 1e-8 THEN 1 END) OVER (PARTITION BY clip_id) ok FROM wi),
hp AS (SELECT clip_id, frame, 'l' side, (x9-cx)/CASE WHEN w > 1e-8 THEN w ELSE med END x, (y9-cy)/CASE WHEN w > 1e-8 THEN w ELSE med END y FROM wm WHERE ok >= 2
  UNION ALL SELECT clip_id, frame, 'r', (x10-cx)/CASE WHEN w > 1e-8 THEN w ELSE med END, (y10-cy)/CASE WHEN w > 1e-8 THEN w ELSE med END FROM wm WHERE ok >= 2),
hn AS (SELECT *, count(*) OVER (PARTITION BY clip_id, side) n FROM hp),
hs AS (SELECT clip_id, side, frame, n,
    (sum(x) OVER w + greatest(0, 1 - frame) * first_value(x) OVER a + greatest(0, frame + 1 - (n - 1)) * last_value(x) OVER a) / 3.0::DOUBLE sx,
    (sum(y) OVER w + greatest(0, 1 - frame) * first_value(y) OVER a + greatest(0, frame + 1 - (n - 1)) * last_value(y) OVER a) / 3.0::DOUBLE sy FROM hn
  WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), a AS (PARTITION BY clip_id, side ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hv AS (SELECT *, sqrt((lead(sx) OVER w - sx)**2 + (lead(sy) OVER w - sy)**2) v FROM hs WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame)),
hg AS (SELECT *, lead(v) OVER (PARTITION BY clip_id, side ORDER BY frame) - v g FROM hv),
sc AS (SELECT clip_id, side, CASE WHEN max(n) < 7 THEN 0 ELSE coalesce(quantile_cont(v, 0.95) * quantile_cont(CASE WHEN g > 0 THEN g END, 0.95), 0) END s FROM hg GROUP BY 1, 2),
lr AS (SELECT c.clip_id, coalesce(max(s) FILTER (side='l'), 0) l, coalesce(max(s) FILTER (side='r'), 0) r, count(s) found FROM (SELECT DISTINCT clip_id FROM pose) c LEFT JOIN sc USING (clip_id) GROUP BY 1)"""


@query(
    "w18_estimate_handedness",
    ctes=(POSE_SQL, FILL_SQL, HAND_SQL),
    sql="""SELECT clip_id, CASE WHEN greatest(l, r) > 1e-12 AND greatest(l, r) / greatest(least(l, r), 1e-12) >= 1.2 THEN CASE WHEN l > r THEN 'left' ELSE 'right' END END handedness, round(l,6) left_motion_score, round(r,6) right_motion_score,
round(CASE WHEN found = 0 THEN 1 ELSE greatest(l, r) / greatest(least(l, r), 1e-12) END, 4) confidence_ratio FROM lr""",
)
def w18(spark, sf_dir):
    out = P.estimate_handedness(pose_joints(spark, sf_dir), min_ratio=1.2)
    return out.select("clip_id", "handedness", *R6("left_motion_score", "right_motion_score"), F.round("confidence_ratio", 4).alias("confidence_ratio"))


@query(
    "w29_dominant_track",
    ctes=(POSE_SQL, FILL_SQL),
    sql="""SELECT clip_id, frame, round(x,6) x, round(y,6) y FROM fil WHERE joint = CASE WHEN handedness = 'left' THEN 9 ELSE 10 END
AND (clip_id, joint) IN (SELECT (clip_id, joint) FROM pose WHERE conf > 0.05 GROUP BY ALL HAVING count(*) >= 2)""",
)
def w29(spark, sf_dir):
    return P.dominant_track(pose_joints(spark, sf_dir), "handedness", "wrist").select("clip_id", "frame", *R6("x", "y"))


@query(
    "a20_pose_agreement",
    ctes=(*BASE, TERM_SQL),
    sql="""SELECT clip_id, round(sum(err*mask) FILTER (kind=0) / sum(mask) FILTER (kind=0),6) pose_distance_2d, round(avg(CASE WHEN err <= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind=0 AND mask > 0.05),6) pck_02,
round(sum(err*180*mask) FILTER (kind=2) / sum(mask) FILTER (kind=2),6) joint_angle_mae_degrees FROM tm GROUP BY 1""",
)
def a20_pose(spark, sf_dir):
    return E.pose_agreement(pairs64(spark, sf_dir)).select("clip_id", *R6("pose_distance_2d", "pck_02", "joint_angle_mae_degrees"))


@query(
    "a21_candidate_skill_means",
    ctes=(GRADED_SQL, CANDIDATE_SQL),
    sql="""SELECT candidate, coalesce(skill, 'all') skill, count(*) samples, round(avg(total_grade),6) mean, round(quantile_cont(total_grade,0.95),6) p95 FROM cand GROUP BY GROUPING SETS ((candidate, skill), (candidate))""",
)
def a21(spark, sf_dir):
    from motionlake.catalog.views import candidates

    rows = candidates(spark, sf_dir).withColumn("status", F.lit("success"))
    return E.metric_summary(rows, ["total_grade"]).select("candidate", "skill", "samples", *R6("mean", "p95"))


@query("x01_vector_norm", ctes=(POSE_SQL,), sql="SELECT clip_id, frame, joint, round(sqrt(x*x + y*y + z*z), 6) norm FROM pose")
def x01(spark, sf_dir):
    from motionlake.functions.columns import norm

    return pose_joints(spark, sf_dir).select("clip_id", "frame", "joint", F.round(norm(F.col("x"), F.col("y"), F.col("z")), 6).alias("norm"))


PHASES = "ph AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}','{n}',{a},{b})" for s in spec.SKILLS for n, a, b in spec.PHASE_WINDOWS[s]
) + ") v(skill, phase, p0, p1))"


@query(
    "j14_phase_windows",
    ctes=(GRADED_SQL, PHASES),
    sql="SELECT clip_id, phase, CAST(clip_id % 64 AS INT) frame FROM graded JOIN ph ON ph.skill = graded.skill AND clip_id % 64 >= p0 AND clip_id % 64 < p1",
)
def j14(spark, sf_dir):
    from motionlake.operators.distance import expand_windows

    rows = graded(spark, sf_dir).select("clip_id", "skill", (F.col("clip_id") % 64).cast("int").alias("frame"))
    return expand_windows(rows, spec.phase_windows(spark)).select("clip_id", "phase", "frame")


# --- long jobs ------------------------------------------------------------------------


def recordings(spark, sf_dir):
    """What is known of every clip before its frames."""
    return pose_joints(spark, sf_dir).select("clip_id", "skill", "label").distinct().withColumns(
        {"filename": F.concat(F.lit("clip_"), F.col("clip_id").cast("string"), F.lit(".mp4")), "fps": F.lit(30.0)}
    )


def prepared(spark, sf_dir):
    """Extraction job over the observed joints of every clip."""
    rows = pose_joints(spark, sf_dir)
    clips = recordings(spark, sf_dir)
    seen = rows.where("conf > 0")
    return PC.prepare_clips(seen.select("clip_id", "frame", "joint", "x", "y", "z"), seen.select("clip_id", "frame", "joint", "x", "y"), clips)


@query("c01_prepare_clips")
def c01(spark, sf_dir):
    sequence, _ = prepared(spark, sf_dir)
    return sequence.select("clip_id", "frame", "p", "c", "anchors")


@query("s07_extraction_summary")
def s07(spark, sf_dir):
    return prepared(spark, sf_dir)[1]


def anchored(spark, sf_dir):
    clips = settle(clips64(spark, sf_dir).withColumn("anchors", F.expr(ANCHOR_EXPR)))
    return clips.withColumn("split", F.when(F.col("clip_id") % 5 == 0, "test").otherwise("training"))


@query("c10_score_report")
def c10(spark, sf_dir):
    clips = anchored(spark, sf_dir)
    report = PS.score_report(clips, clips.where("label = 'experts'"))
    return report.grades.select("clip_id", "skill", "label", *R6("correction_distance", "total_grade"))


@query("c15_grade_batch")
def c15(spark, sf_dir):
    sequence, summary = prepared(spark, sf_dir)
    sequence = settle(sequence)
    from motionlake.catalog.distances import calibration

    return PS.grade_batch(sequence, summary, sequence.where("label = 'experts'"), calibration(spark))


@query("c12_audit_corrections")
def c12(spark, sf_dir):
    clips = anchored(spark, sf_dir)
    experts = clips.where("label = 'experts'")
    rows, _ = PE.audit_corrections(
        clips.where("label = 'beginners'"), experts.where("clip_id % 2000 < 1000"), experts.where("clip_id % 2000 >= 1000"), 0.3
    )
    return rows.select("clip_id", "skill", *R6("input_nearest_expert_distance", "corrected_nearest_expert_distance"), "within_expert_range")


@query("c14_shadow_grading")
def c14(spark, sf_dir):
    """Two candidate sources: the clips themselves and a slightly scaled copy."""
    base = W.phase_align(anchored(spark, sf_dir).drop("split")).select("clip_id", "frame", "p", "c", "skill", "label")
    shrink = "transform(p, v -> v * 0.95D)"
    both = base.withColumn("candidate", F.lit("oracle")).withColumn("subject", F.col("clip_id")).unionByName(
        base.withColumn("p", F.expr(shrink)).withColumn("candidate", F.lit("scaled")).withColumn("subject", F.col("clip_id")).withColumn("clip_id", F.col("clip_id") + 1000000)
    )
    scored, criteria, _ = PE.shadow_grading(settle(both))
    compared = PE.against_oracle(scored, criteria, "oracle")
    return compared.select("clip_id", "candidate", "split", *R6("total_score", "oracle_total_score", "criterion_score_mae"))


@query("w20_dynamic_time_warping")
def w20(spark, sf_dir):
    """Dominant wrist of every 64-frame clip against the next clip of its label."""
    wrist = F.slice("p", 31, 3)
    points = clips64(spark, sf_dir).groupBy("clip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame", wrist.alias("p")))), lambda r: r["p"]).alias("pts")
    )
    other = points.select((F.col("clip_id") - 1).alias("clip_id"), F.col("pts").alias("b"))
    return M.dtw(points.withColumnRenamed("pts", "a").join(other, "clip_id"), ["clip_id"])


@query("w20_nearest_track")
def w20_nearest(spark, sf_dir):
    """Dominant wrist of every beginner against all experts of its skill, whole recordings."""
    wrist = F.slice("p", 31, 3)
    points = pose_frames(spark, sf_dir).groupBy("clip_id", "skill", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame", wrist.alias("p")))), lambda r: r["p"]).alias("pts")
    )
    found = warping.nearest_track(points.where("label = 'beginners'"), points.where("label = 'experts'"), ["skill"])
    return found.select("clip_id", "nearest", *R6("cost"), "candidates")


@query("w20_long_pair")
def w20_long(spark, sf_dir):
    """Events of even users against those of odd users, each as one track in time order."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 2).alias("side"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("x"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"),
    )
    numbered = settle(number_rows(events, ["side"], ["ts", "event_id"], F.floor(F.unix_seconds("ts") / 86400)))
    sides = [numbered.where(F.col("side") == k).select("frame", "x", "y") for k in (0, 1)]
    path, cost = warping.warp_long(*sides)
    return path.withColumn("cost", F.round(F.lit(cost), 6))


@query("c18_overlay_coordinates")
def c18(spark, sf_dir):
    pairs = pairs64(spark, sf_dir).withColumn("px", F.expr("flatten(transform(sequence(0, 16), j -> array(100 * s[3*j] + 10 * s[3*j+2], 200 * s[3*j+1] + 5)))"))
    return M.overlay_coordinates(pairs)


# --- files ----------------------------------------------------------------------------


def _folder(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s06_clip_store",
    ctes=(POSE_SQL,),
    sql="SELECT clip_id, label, frame, round(x, 6) nose_x FROM pose WHERE skill = 'clear' AND joint = 0",
)
def s06(spark, sf_dir):
    folder = _folder(spark, "clips")
    archives.write_clips(pose_frames(spark, sf_dir), folder)
    stored = archives.read_clips(spark, folder, skill="clear")
    return stored.select("clip_id", "label", "frame", F.round(F.get("p", 0), 6).alias("nose_x"))


@query("s12_grades_csv", ctes=(GRADED_SQL,), sql="SELECT filename, label, round(total_grade,6) total_grade FROM graded")
def s12(spark, sf_dir):
    folder = _folder(spark, "grades")
    tables.write_csv(graded(spark, sf_dir).select("filename", "label", "total_grade"), folder)
    rows = tables.read_grades(spark, folder, ["filename", "label", "total_grade"])
    return rows.select("filename", "label", F.round(F.col("total_grade").cast("double"), 6).alias("total_grade"))


@query(
    "s14_manifest_csv",
    ctes=(GRADED_SQL,),
    sql="SELECT skill, label AS \"group\", split AS role, CAST(clip_id AS VARCHAR) subject, handedness, '/v/' || clip_id video_path, '/b/' || clip_id baseline_path FROM graded",
)
def s14(spark, sf_dir):
    folder = _folder(spark, "manifest")
    key = F.col("clip_id").cast("string")
    rows = graded(spark, sf_dir).select(
        "skill", F.col("label").alias("group"), F.col("split").alias("role"), key.alias("subject"), "handedness",
        F.concat(F.lit("/v/"), key).alias("video_path"), F.concat(F.lit("/b/"), key).alias("baseline_path"),
    )
    tables.write_csv(rows, folder)
    return tables.read_manifest(spark, folder)


@query(
    "s11_calibration_json",
    ctes=("RECURSIVE " + GRADED_SQL.strip(), _calibrate_sql("45", "99")),
    sql="SELECT skill, round(b.o, 6) distance_offset, round(b.a, 5) alpha, 45.0::DOUBLE target_beginner_mean, 99.0::DOUBLE target_expert_mean, b.ok target_reachable FROM calib",
)
def s11(spark, sf_dir):
    folder = _folder(spark, "calibration")
    tables.write_calibration(G.fit_calibration(graded(spark, sf_dir)), folder)
    stored = tables.read_calibration(spark, folder)
    return stored.select(
        "skill", *R6("distance_offset"), F.round("alpha", 5).alias("alpha"),
        "target_beginner_mean", "target_expert_mean", "target_reachable",
    )


@query("s03_media_listing")
def s03(spark, sf_dir):
    return archives.list_media(spark, sf_dir, (".parquet",)).select("filename", "length")


@query("s01_sequence_listing")
def s01(spark, sf_dir):
    return archives.list_sequences(spark, sf_dir, suffix="parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"))
