"""Queries over pairs of poses: distances, matching, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionlake import spec
from motionlake.catalog.poses import (
    ANCHOR_EXPR,
    ALIGN_SQL,
    BONES_SQL,
    CLIP_ANCHOR_SQL,
    R6,
    RESAMPLE_SQL,
    TRIPLETS_SQL,
    aligned,
    clips64,
)
from motionlake.catalog.registry import query
from motionlake.catalog.views import POSE_SQL
from motionlake.operators import distance as D
from motionlake.operators import grading as G
from motionlake.operators import matching as M
from motionlake.operators import models
from motionlake.session import inline_table, settle

WEIGHT_SQL = "jw AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}',{j},{w}::DOUBLE)" for s in spec.SKILLS for j, w in enumerate(spec.JOINT_WEIGHTS[s])
) + ") v(skill, joint, w))"

PAIR_SQL = """
pr AS (SELECT a.clip_id, a.frame, a.joint, a.skill, a.x sx, a.y sy, a.z sz, b.x tx, b.y ty, b.z tz, a.conf * b.conf c
       FROM rs a JOIN rs b ON b.clip_id = a.clip_id + 1 AND b.frame = a.frame AND b.joint = a.joint)"""


def pairs64(spark, sf_dir):
    """Every clip against the next clip of its label, both resampled to 64 frames."""
    a = clips64(spark, sf_dir).select("clip_id", "frame", "skill", "p", "c")
    b = a.withColumn("clip_id", F.col("clip_id") - 1)
    return D.pairs(a, b, merge="product")


def stored_pairs(spark, sf_dir):
    """The same pairs, written out once for queries that read them several times."""
    return settle(pairs64(spark, sf_dir))


def _len(p: str, q: str, n: str) -> str:
    return "sqrt(" + "+".join(f"({p}.{n}{d}-{q}.{n}{d})**2" for d in "xyz") + ")"


def _ang(n: str, training: bool = False) -> str:
    dot = "+".join(f"(a.{n}{d}-b.{n}{d})*(c.{n}{d}-b.{n}{d})" for d in "xyz")
    size = f"({_len('a', 'b', n)}*{_len('c', 'b', n)})"
    if training:
        return f"acos(greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, ({dot})/greatest({size},1e-8))))"
    return f"acos(greatest(-1, least(1, CASE WHEN {size} > 1e-8 THEN ({dot})/{size} ELSE 1 END)))"


def _terms_sql(training: bool = False) -> str:
    bone = BONES_SQL.replace("b(k, a, b)", "q(k, ja, jb)")
    trip = TRIPLETS_SQL.replace("b(k, a, b, c)", "q(k, ja, jb, jc)")
    joined = lambda alias, j: f"JOIN pr {alias} ON {alias}.joint = q.{j}" + ("" if alias == "a" else f" AND {alias}.clip_id = a.clip_id AND {alias}.frame = a.frame")
    d = "+".join(f"(s{x}-t{x})**2" for x in "xyz")
    v = "+".join(f"((s{x}-lag(s{x}) OVER w)-(t{x}-lag(t{x}) OVER w))**2" for x in "xyz")
    return f"""
tm AS (
 SELECT clip_id, frame, skill, 0 kind, joint idx, joint ja, joint jb, sqrt({d}) err, c mask, sqrt({v}) verr, c * lag(c) OVER w vmask
 FROM pr WINDOW w AS (PARTITION BY clip_id, joint ORDER BY frame)
 UNION ALL
 SELECT a.clip_id, a.frame, a.skill, 1, q.k, q.ja, q.jb, abs({_len('a','b','s')} - {_len('a','b','t')}), a.c * b.c, NULL, NULL
 FROM {bone} {joined('a','ja')} {joined('b','jb')}
 UNION ALL
 SELECT a.clip_id, a.frame, a.skill, 2, q.k, q.ja, q.jb, abs({_ang('s', training)} - {_ang('t', training)}) / pi(), a.c * b.c * c.c, NULL, NULL
 FROM {trip} {joined('a','ja')} {joined('b','jb')} {joined('c','jc')})"""


TERM_SQL = _terms_sql()


def _mm(v, m, cond, w=""):
    return f"CASE WHEN coalesce(sum({m}{w}) FILTER ({cond}), 0) < 1e-8 THEN 0 ELSE sum({v}*{m}{w}) FILTER ({cond}) / sum({m}{w}) FILTER ({cond}) END"


def _components_sql(name: str, base: str, by: str, moving: str = "true", on: str = "jw.skill = m.skill") -> str:
    return f"""
{name} AS (SELECT {by}, {_mm('err','mask','kind=0','*w')} pos, {_mm('err','mask','kind=2')} ang,
  {_mm('verr','vmask',f'kind=0 AND {moving}','*w')} vel, {_mm('err','mask','kind=1')} bone
  FROM {base} m JOIN jw ON {on} AND jw.joint = m.ja GROUP BY ALL)"""


COMP_SQL = _components_sql("comp", "tm", "m.clip_id, m.skill")

TRANS_SQL = f"""
lean0 AS (SELECT clip_id, skill, frame,
   atan2(sum(CASE WHEN joint IN (5,6) THEN sz ELSE -sz END) * 0.5::DOUBLE, sum(CASE WHEN joint IN (5,6) THEN sy ELSE -sy END) * 0.5::DOUBLE) ls,
   atan2(sum(CASE WHEN joint IN (5,6) THEN tz ELSE -tz END) * 0.5::DOUBLE, sum(CASE WHEN joint IN (5,6) THEN ty ELSE -ty END) * 0.5::DOUBLE) lt,
   product(c) lc FROM pr WHERE joint IN (5,6,11,12) GROUP BY 1,2,3),
lean1 AS (SELECT a.clip_id, a.frame, abs((a.ls-z.ls)-(a.lt-z.lt)) err, a.lc*z.lc m FROM lean0 a JOIN lean0 z ON z.clip_id=a.clip_id AND z.frame=0),
lean2 AS (SELECT clip_id, 0.5::DOUBLE*{_mm('err','m','true')} + 0.5::DOUBLE*{_mm('err','m','frame=63')} torso FROM lean1 GROUP BY 1),
sup1 AS (SELECT a.clip_id, a.frame, sqrt({"+".join(f"((a.s{x}-z.s{x})-(a.t{x}-z.t{x}))**2" for x in "xyz")}) err, a.c*z.c m
   FROM pr a JOIN pr z ON z.clip_id=a.clip_id AND z.joint=a.joint AND z.frame=0 WHERE a.joint BETWEEN 11 AND 16),
sup2 AS (SELECT clip_id, 0.5::DOUBLE*{_mm('err','m','true')} + 0.5::DOUBLE*{_mm('err','m','frame=63')} support FROM sup1 GROUP BY 1),
trans AS (SELECT clip_id, support, torso, 0.65::DOUBLE*support + 0.35::DOUBLE*torso trans FROM sup2 JOIN lean2 USING (clip_id))"""

BASE = (POSE_SQL, RESAMPLE_SQL, WEIGHT_SQL, PAIR_SQL)
TOTAL = "pos + 0.5::DOUBLE*ang + 0.5::DOUBLE*vel + 0.25::DOUBLE*bone"


@query(
    "a01_masked_mean",
    ctes=(POSE_SQL, WEIGHT_SQL),
    sql=f"SELECT clip_id, round({_mm('abs(x)', 'conf', 'true', '*w')}, 6) weighted, round({_mm('abs(x)', 'conf', 'joint < 0')}, 6) nothing FROM pose p JOIN jw USING (skill, joint) GROUP BY 1",
)
def a01(spark, sf_dir):
    from motionlake.catalog.views import pose_joints
    from motionlake.functions.columns import masked_mean

    rows = pose_joints(spark, sf_dir)
    weight = F.get(spec.joint_weight_array(), F.col("joint"))
    return rows.groupBy("clip_id").agg(
        F.round(masked_mean(F.abs("x"), F.col("conf"), weight), 6).alias("weighted"),
        F.round(masked_mean(F.abs("x"), F.col("conf") * 0.0), 6).alias("nothing"),
    )


@query(
    "j05_pair_join",
    ctes=BASE,
    sql="SELECT clip_id, frame, joint, round(sx,6) sx, round(tx,6) tx, round(c,6) c FROM pr",
)
def j05(spark, sf_dir):
    rows = pairs64(spark, sf_dir).select("clip_id", "frame", F.explode(F.array(*[F.lit(j) for j in range(17)])).alias("joint"), "s", "t", F.col("c").alias("cc"))
    return rows.selectExpr("clip_id", "frame", "joint", "round(s[3*joint],6) sx", "round(t[3*joint],6) tx", "round(cc[joint],6) c")


@query(
    "a06_distance_components",
    ctes=(*BASE, TERM_SQL, COMP_SQL),
    sql="SELECT clip_id, skill, round(pos,6) position_distance, round(ang,6) angle_distance, round(vel,6) velocity_distance, round(bone,6) bone_length_distance FROM comp",
)
def a06(spark, sf_dir):
    out = D.distance_components(pairs64(spark, sf_dir))
    return out.select("clip_id", "skill", *R6("position_distance", "angle_distance", "velocity_distance", "bone_length_distance"))


@query(
    "a07_transition_components",
    ctes=(*BASE, TRANS_SQL),
    sql="SELECT clip_id, round(support,6) support_transition_distance, round(torso,6) torso_lean_transition_distance, round(trans,6) transition_distance FROM trans",
)
def a07(spark, sf_dir):
    out = D.transition_components(stored_pairs(spark, sf_dir))
    return out.select("clip_id", *R6("support_transition_distance", "torso_lean_transition_distance", "transition_distance"))


A08_SQL = f"""
tot AS (SELECT c.clip_id, c.skill, pos, ang, vel, bone, CASE WHEN c.skill='serve' THEN trans ELSE 0 END trans,
  {TOTAL} + CASE WHEN c.skill='serve' THEN trans ELSE 0 END total FROM comp c JOIN trans t USING (clip_id))"""


@query(
    "a08_correction_distance",
    ctes=(*BASE, TERM_SQL, COMP_SQL, TRANS_SQL, A08_SQL),
    sql="SELECT clip_id, skill, round(total,6) correction_distance, round(trans,6) transition_distance FROM tot",
)
def a08(spark, sf_dir):
    out = D.correction_distance(stored_pairs(spark, sf_dir))
    return out.select("clip_id", "skill", *R6("correction_distance", "transition_distance"))


def _keypoint_sql(name: str, base: str, by: str, moving: str = "true") -> str:
    return f"""
{name}_s AS (SELECT {by}, kind, idx, ja, jb, sum(err*mask) num, sum(mask) den, sum(verr*vmask) FILTER ({moving}) vnum, sum(vmask) FILTER ({moving}) vden FROM {base} GROUP BY ALL),
{name}_o AS (SELECT *, unnest(CASE WHEN kind = 1 THEN [ja, jb] ELSE [jb] END) joint FROM {name}_s),
{name} AS (SELECT {by}, joint, coalesce(avg(CASE WHEN den > 1e-8 THEN num/den END) FILTER (kind=0), 0) pos,
  coalesce(avg(CASE WHEN den > 1e-8 THEN num/den END) FILTER (kind=2), 0) ang,
  coalesce(sum(CASE WHEN vden > 1e-8 THEN vnum/vden END) FILTER (kind=0), 0) vel,
  coalesce(avg(CASE WHEN den > 1e-8 THEN num/den END) FILTER (kind=1), 0) bone FROM {name}_o GROUP BY ALL)"""


KEYPOINT_SQL = _keypoint_sql("kp", "tm", "clip_id, skill")


@query(
    "a09_keypoint_components",
    ctes=(*BASE, TERM_SQL, KEYPOINT_SQL),
    sql=f"SELECT clip_id, CAST(joint AS INT) joint, round(pos,6) position_distance, round(ang,6) angle_distance, round(vel,6) velocity_distance, round(bone,6) bone_length_distance, round({TOTAL},6) correction_distance FROM kp",
)
def a09(spark, sf_dir):
    out = D.keypoint_components(D.frame_terms(pairs64(spark, sf_dir)))
    return out.select("clip_id", "joint", *R6("position_distance", "angle_distance", "velocity_distance", "bone_length_distance", "correction_distance"))


@query(
    "a10_quality_metrics",
    ctes=(*BASE, f"""
dl AS (SELECT clip_id, joint, frame, c, tx-sx dx, ty-sy dy, tz-sz dz FROM pr),
dv AS (SELECT *, sqrt(dx**2+dy**2+dz**2) mag, {" , ".join(f"d{x}-lag(d{x}) OVER w v{x}" for x in "xyz")}, c*lag(c) OVER w vm, c*lag(c) OVER w*lag(c,2) OVER w am FROM dl WINDOW w AS (PARTITION BY clip_id, joint ORDER BY frame)),
da AS (SELECT *, sqrt(vx**2+vy**2+vz**2) vel, sqrt({"+".join(f"(v{x}-lag(v{x}) OVER w)**2" for x in "xyz")}) acc FROM dv WINDOW w AS (PARTITION BY clip_id, joint ORDER BY frame)),
mo AS (SELECT clip_id, coalesce(avg(mag) FILTER (c>0),0) a, coalesce(max(mag) FILTER (c>0),0) b, {_mm('vel','vm','true')} cv, {_mm('acc','am','true')} ca FROM da GROUP BY 1),
bo AS (SELECT a.clip_id, avg(ch) m, quantile_cont(ch, 0.95) p FROM (SELECT a.clip_id, abs({_len('a','b','t')}-{_len('a','b','s')})/greatest({_len('a','b','s')},0.1::DOUBLE) ch
   FROM {BONES_SQL.replace("b(k, a, b)", "q(k, ja, jb)")} JOIN pr a ON a.joint=q.ja JOIN pr b ON b.joint=q.jb AND b.clip_id=a.clip_id AND b.frame=a.frame WHERE a.c*b.c>0) a GROUP BY 1)"""),
    sql="""SELECT clip_id, round(a,6) mean_joint_correction, round(b,6) max_joint_correction, round(coalesce(m,0),6) mean_relative_bone_change,
round(coalesce(p,0),6) p95_relative_bone_change, round(cv,6) mean_correction_velocity, round(ca,6) mean_correction_acceleration FROM mo LEFT JOIN bo USING (clip_id)""",
)
def a10(spark, sf_dir):
    out = D.quality_metrics(stored_pairs(spark, sf_dir))
    return out.select("clip_id", *R6("mean_joint_correction", "max_joint_correction", "mean_relative_bone_change", "p95_relative_bone_change", "mean_correction_velocity", "mean_correction_acceleration"))


ANCHOR_DIST_SQL = """
an AS (SELECT clip_id, unnest(range(0,5)) phase, unnest(anc) anchor FROM ca),
nr AS (SELECT t.*, an.phase, an.anchor FROM tm t JOIN an ON an.clip_id = t.clip_id AND t.frame BETWEEN anchor - 2 AND anchor + 2)"""


@query(
    "w26_anchor_distances",
    ctes=(*BASE, CLIP_ANCHOR_SQL, TERM_SQL, ANCHOR_DIST_SQL, _components_sql("nc", "nr", "m.clip_id, m.phase, m.anchor", "m.frame > greatest(0, m.anchor - 2)")),
    sql=f"SELECT clip_id, CAST(phase AS INT) phase, CAST(anchor AS INT) anchor, round({TOTAL},6) phase_distance FROM nc",
)
def w26(spark, sf_dir):
    out = D.anchor_distances(pairs64(spark, sf_dir).withColumn("anchors", F.expr(ANCHOR_EXPR)))
    return out.select("clip_id", "phase", "anchor", *R6("phase_distance"))


@query(
    "a23_batch_losses",
    ctes=(POSE_SQL, RESAMPLE_SQL, WEIGHT_SQL, PAIR_SQL, _terms_sql(True), "tb AS (SELECT *, (clip_id // 1000) % 3 batch FROM tm)",
          _components_sql("comp", "tb", "m.skill, m.batch"),
          TRANS_SQL.split("lean2 AS")[0].rstrip().rstrip(",") + f""",
lt2 AS (SELECT (clip_id // 1000) % 3 batch, 0.5::DOUBLE*{_mm('err','m','true')} + 0.5::DOUBLE*{_mm('err','m','frame=63')} torso FROM lean1 WHERE clip_id % 1000 % 4 = 0 GROUP BY 1),
sp1 AS (SELECT (a.clip_id // 1000) % 3 batch, a.frame, sqrt({"+".join(f"((a.s{x}-z.s{x})-(a.t{x}-z.t{x}))**2" for x in "xyz")}) err, a.c*z.c m
   FROM pr a JOIN pr z ON z.clip_id=a.clip_id AND z.joint=a.joint AND z.frame=0 WHERE a.joint BETWEEN 11 AND 16 AND a.skill = 'serve'),
sp2 AS (SELECT batch, 0.5::DOUBLE*{_mm('err','m','true')} + 0.5::DOUBLE*{_mm('err','m','frame=63')} support FROM sp1 GROUP BY 1),
bl AS (SELECT c.*, CASE WHEN skill='serve' THEN 0.65::DOUBLE*support+0.35::DOUBLE*torso ELSE 0 END trans FROM comp c LEFT JOIN sp2 USING (batch) LEFT JOIN lt2 USING (batch))"""),
    sql="SELECT skill, round(avg(pos + 0.5::DOUBLE*vel + 0.25::DOUBLE*ang + bone + trans),6) loss, round(avg(trans),6) transition_distance, count(*) batches FROM bl GROUP BY 1",
)
def a23(spark, sf_dir):
    rows = stored_pairs(spark, sf_dir).withColumn("batch", F.expr("(clip_id div 1000) % 3"))
    out = D.epoch_loss(D.batch_losses(rows, "batch"))
    return out.select("skill", *R6("loss", "transition_distance"), "batches")


# --- matching ---------------------------------------------------------------------


def cohorts(spark, sf_dir):
    clips = settle(aligned(spark, sf_dir))
    return clips.where("label = 'beginners'"), clips.where("label = 'experts'")


MATCH_SQL = """
ed AS (SELECT s.clip_id, e.clip_id expert_id, CASE WHEN sum(s.conf*e.conf) > 1e-8 THEN
   sum(sqrt((s.x-e.x)**2+(s.y-e.y)**2+(s.z-e.z)**2)*s.conf*e.conf)/sum(s.conf*e.conf) ELSE 'inf'::DOUBLE END dist
  FROM al s JOIN al e ON e.label = 'experts' AND e.skill = s.skill AND e.handedness = s.handedness AND e.frame = s.frame AND e.joint = s.joint
  WHERE {where} GROUP BY 1, 2)"""
STUDENTS, LEAVE_ONE_OUT = "s.label = 'beginners'", "s.label = 'experts' AND s.clip_id <> e.clip_id"
ALIGNED = (POSE_SQL, RESAMPLE_SQL, CLIP_ANCHOR_SQL, ALIGN_SQL)


@query(
    "a11_euclidean_to_bank",
    ctes=(*ALIGNED, MATCH_SQL.format(where=STUDENTS)),
    sql="SELECT clip_id, count(*) experts, round(min(dist),6) distance, round(avg(dist),6) mean_distance FROM ed GROUP BY 1",
)
def a11(spark, sf_dir):
    out = M.match_expert_euclidean(*cohorts(spark, sf_dir))
    return out.select("clip_id", "experts", *R6("distance", "mean_distance"))


@query(
    "t15_nearest_expert",
    ctes=(*ALIGNED, MATCH_SQL.format(where=STUDENTS)),
    sql="SELECT clip_id, arg_min(expert_id, struct_pack(d := dist, e := expert_id)) expert_id FROM ed GROUP BY 1",
)
def t15(spark, sf_dir):
    return M.match_expert_euclidean(*cohorts(spark, sf_dir)).select("clip_id", "expert_id")


@query(
    "j03_leave_one_out",
    ctes=(*ALIGNED, MATCH_SQL.format(where=LEAVE_ONE_OUT)),
    sql="SELECT clip_id, arg_min(expert_id, struct_pack(d := dist, e := expert_id)) expert_id, count(*) experts, round(min(dist),6) distance FROM ed GROUP BY 1",
)
def j03(spark, sf_dir):
    _, experts = cohorts(spark, sf_dir)
    out = M.match_expert_euclidean(experts, experts, exclude_self=True)
    return out.select("clip_id", "expert_id", "experts", *R6("distance"))


@query(
    "a13_expert_variability",
    ctes=(*ALIGNED, MATCH_SQL.format(where=LEAVE_ONE_OUT), "nd AS (SELECT clip_id, min(dist) d FROM ed GROUP BY 1)"),
    sql="""SELECT skill, count(*) "count", round(avg(d),6) mean_nearest, round(quantile_cont(d,0.95),6) p95_nearest, round(max(d),6) max_nearest
FROM nd JOIN (SELECT DISTINCT clip_id, skill FROM pose) USING (clip_id) GROUP BY 1 HAVING count(*) >= 2""",
)
def a13(spark, sf_dir):
    from motionlake.operators.evaluate import expert_variability

    _, experts = cohorts(spark, sf_dir)
    out = expert_variability(experts).where("error = ''")
    return out.select("skill", "count", *R6("mean_nearest", "p95_nearest", "max_nearest"))


@query(
    "a13_variability_errors",
    ctes=(*ALIGNED, MATCH_SQL.format(where=LEAVE_ONE_OUT + " AND s.clip_id % 1000 < s.clip_id // 1000 * 2 AND e.clip_id % 1000 < e.clip_id // 1000 * 2"), "nd AS (SELECT clip_id, min(dist) d FROM ed GROUP BY 1)"),
    sql="""SELECT skill, count(d) "count", CASE WHEN count(d) >= 2 THEN round(avg(d),6) END mean_nearest, CASE WHEN count(d) >= 2 THEN '' ELSE 'at least two experts are required to measure variability' END error
FROM (SELECT DISTINCT clip_id, skill FROM al WHERE label = 'experts' AND clip_id % 1000 < clip_id // 1000 * 2) LEFT JOIN nd USING (clip_id) GROUP BY 1""",
)
def a13_errors(spark, sf_dir):
    """A bank that holds 2, 4 and 6 clips of its labels: some skills lack a second expert."""
    from motionlake.operators.evaluate import expert_variability

    _, experts = cohorts(spark, sf_dir)
    few = experts.where("clip_id % 1000 < floor(clip_id / 1000) * 2")
    return expert_variability(few).select("skill", "count", *R6("mean_nearest"), "error")


@query(
    "j01_candidate_counts",
    ctes=(*ALIGNED, MATCH_SQL.format(where=STUDENTS)),
    sql="SELECT clip_id, count(*) experts FROM ed GROUP BY 1",
)
def j01(spark, sf_dir):
    return M.match_expert_euclidean(*cohorts(spark, sf_dir)).select("clip_id", "experts")


@query(
    "j02_no_expert",
    ctes=(*ALIGNED,),
    sql="""SELECT DISTINCT clip_id, 'no same-handed expert is available' error FROM al s WHERE label = 'beginners'
AND NOT EXISTS (SELECT 1 FROM al e WHERE e.label = 'experts' AND e.skill = s.skill AND e.handedness = s.handedness AND e.clip_id % 1000 > 3)""",
)
def j02(spark, sf_dir):
    students, experts = cohorts(spark, sf_dir)
    return M.without_expert(students, experts.where("clip_id % 1000 > 3"))


PLAIN_MATCH_SQL = f"""
pr AS (SELECT s.clip_id * 100000 + e.clip_id clip_id, s.frame, s.joint, s.skill, s.x sx, s.y sy, s.z sz, e.x tx, e.y ty, e.z tz, s.conf*e.conf c
  FROM al s JOIN al e ON e.label = 'experts' AND e.skill = s.skill AND e.handedness = s.handedness AND e.frame = s.frame AND e.joint = s.joint WHERE s.label = 'beginners')"""


@query(
    "c03_match_unadapted",
    ctes=(*ALIGNED, WEIGHT_SQL, PLAIN_MATCH_SQL, TERM_SQL, COMP_SQL, TRANS_SQL, A08_SQL),
    sql="""SELECT CAST(clip_id // 100000 AS INT) clip_id, CAST(arg_min(clip_id % 100000, struct_pack(d := total, e := clip_id)) AS INT) expert_id, round(min(total),6) distance, count(*) experts FROM tot GROUP BY 1""",
)
def c03_plain(spark, sf_dir):
    out = M.match_expert(*cohorts(spark, sf_dir), iterations=0)
    return out.select("clip_id", "expert_id", *R6("distance"), "experts")


@query("c03_match_expert")
def c03(spark, sf_dir):
    out = M.match_expert(*cohorts(spark, sf_dir))
    return out.select("clip_id", "expert_id", *R6("distance"), "experts")


CUT_SQL = """
cu AS (SELECT clip_id, skill, handedness, label, CASE WHEN label = 'beginners' AND clip_id % 3 = 1 THEN 60 WHEN label = 'beginners' AND clip_id % 3 = 2 THEN 80 ELSE 64 END n
  FROM (SELECT DISTINCT clip_id, skill, handedness, label FROM al))"""


@query(
    "c03_match_coverage",
    ctes=(*ALIGNED, CUT_SQL),
    sql="""SELECT clip_id, CASE WHEN NOT EXISTS (SELECT 1 FROM cu e WHERE e.label = 'experts' AND e.skill = s.skill AND e.handedness = s.handedness) THEN 'no same-handed expert is available'
WHEN n <> 64 THEN 'no expert clip has ' || n || ' frames' ELSE 'matched' END outcome FROM cu s WHERE label = 'beginners'""",
)
def c03_coverage(spark, sf_dir):
    """Clips of 60, 64 and 80 frames: every student is matched or named with its reason."""
    students, experts = cohorts(spark, sf_dir)
    kind = F.expr("clip_id % 3")
    longer = students.where((kind == 2) & (F.col("frame") < 16)).withColumn("frame", F.col("frame") + 64)
    cut = students.where((kind != 1) | (F.col("frame") < 60)).unionByName(longer)
    matched = M.match_expert_euclidean(cut, experts).select("clip_id", F.lit("matched").alias("outcome"))
    return matched.unionByName(M.match_errors(cut, experts).withColumnRenamed("error", "outcome"))


@query("c02_adapt_bone_lengths")
def c02(spark, sf_dir):
    return M.adapt_bone_lengths(pairs64(spark, sf_dir)).select("clip_id", "frame", "t")


@query("c04_match_euclidean_adapted")
def c04(spark, sf_dir):
    students, experts = cohorts(spark, sf_dir)
    matches = M.match_expert_euclidean(students, experts)
    return M.adapt_bone_lengths(M.with_expert(students, experts, matches)).select("clip_id", "frame", "expert_id", "t")


def corrected(spark, sf_dir):
    """Anchored 64-frame clips, corrected towards the experts of their hand."""
    clips = settle(clips64(spark, sf_dir).withColumn("anchors", F.expr(ANCHOR_EXPR)))
    _, experts = cohorts(spark, sf_dir)
    return M.correct_clips(clips, experts)


@query("c05_correct_clips")
def c05(spark, sf_dir):
    return corrected(spark, sf_dir).select("clip_id", "frame", "expert_id", "t")


@query("c06_training_pairs")
def c06(spark, sf_dir):
    return M.build_training_pairs(*cohorts(spark, sf_dir)).select("clip_id", "frame", "expert_id", "features", "t", "c")


class _Still:
    """A session that predicts the source pose."""

    name = "features"

    def get_inputs(self):
        return [self]

    def run(self, outputs, feed):
        return [feed[self.name][..., :3]]


@query(
    "ud1_session_model",
    ctes=(POSE_SQL, RESAMPLE_SQL),
    sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, true near FROM rs",
)
def ud1(spark, sf_dir):
    """Predictions of a session that every Python worker loads once; single precision."""
    rows = clips64(spark, sf_dir).select("clip_id", "frame", F.col("p").alias("s"), F.col("p").alias("t"), F.col("c").alias("own_c"))
    out = models.session_model("still", _Still)(rows)
    joint = F.explode(F.array(*[F.lit(j) for j in range(spec.JOINTS)])).alias("joint")
    near = " AND ".join(f"abs(m[3 * joint + {d}] - s[3 * joint + {d}]) < 1e-6" for d in range(3))
    return out.select("clip_id", "frame", "s", "m", joint).selectExpr(
        "clip_id", "frame", "joint", "round(s[3 * joint], 6) x", "round(s[3 * joint + 1], 6) y", "round(s[3 * joint + 2], 6) z", f"{near} near"
    )


# --- grades -----------------------------------------------------------------------

CAL_ROWS = [("serve", 0.46083, 3.92212), ("lift", 0.27962, 3.38692), ("clear", 0.34778, 3.18732), ("smash", 0.31917, 3.43301)]
CAL_SQL = "cal AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}',{o}::DOUBLE,{a}::DOUBLE)" for s, o, a in CAL_ROWS) + ") v(skill, o, alpha))"


def calibration(spark):
    return inline_table(spark, CAL_ROWS, "skill string, distance_offset double, alpha double")


def _criteria_values() -> str:
    rows = []
    for s in spec.SKILLS:
        for k, r in enumerate(spec.RULES[s]):
            joints = "NULL" if r[9] is None else str(list(r[9]))
            kind = "t" if r[0] == "weight_transfer" else "j" if r[9] else "w"
            rows.append(f"('{s}',{k},'{r[0]}',{r[3]}::DOUBLE,{r[7]},{r[8]},{joints}::INT[],'{kind}')")
    return "crit AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(skill, k, rule_id, mx, s0, s1, js, kind))"


CRITERIA_SQL = _criteria_values()
CRITERION_SQL = f"""
cw AS (SELECT t.*, q.k, q.s0 FROM tm t JOIN crit q ON q.skill = t.skill AND t.frame >= q.s0 AND t.frame < q.s1 WHERE q.kind = 'w'),
{_components_sql("cwc", "cw", "m.clip_id, m.skill, m.k", "m.frame > m.s0").strip()},
cd AS (
 SELECT clip_id, skill, k, {TOTAL} dist FROM cwc
 UNION ALL SELECT t.clip_id, t.skill, q.k, {_mm('err','mask','true')} FROM tm t JOIN crit q ON q.skill = t.skill AND t.kind = 0 AND t.frame >= q.s0 AND t.frame < q.s1 AND q.kind = 'j' AND list_contains(q.js, CAST(t.ja AS INT)) GROUP BY 1,2,3
 UNION ALL SELECT c.clip_id, c.skill, q.k, trans FROM comp c JOIN trans USING (clip_id) JOIN crit q ON q.skill = c.skill AND q.kind = 't')"""
GRADE_SQL = """
g0 AS (SELECT d.clip_id, d.skill, d.k, q.rule_id, q.mx, d.dist, q.mx * (100 * exp(-alpha * greatest(d.dist - o, 0))) / 100 g, 100 * exp(-alpha * greatest(t.total - o, 0)) tg
   FROM cd d JOIN crit q USING (skill, k) JOIN cal USING (skill) JOIN tot t ON t.clip_id = d.clip_id),
g1 AS (SELECT *, sum(g) OVER (PARTITION BY clip_id) raw, sum(mx - g) OVER (PARTITION BY clip_id) room FROM g0),
g2 AS (SELECT *, CASE WHEN raw > tg AND raw > 1e-8 THEN g * tg / raw WHEN raw < tg AND room > 1e-8 THEN g + (tg - raw) * (mx - g) / room ELSE g END grade FROM g1)"""
GRADED = (*BASE, TERM_SQL, COMP_SQL, TRANS_SQL, A08_SQL, CAL_SQL, CRITERIA_SQL, CRITERION_SQL)


@query(
    "p23_criterion_distances",
    ctes=GRADED,
    sql="SELECT clip_id, skill, CAST(k AS INT) k, rule_id, mx maximum, round(dist,6) distance FROM cd JOIN crit USING (skill, k)",
)
def p23(spark, sf_dir):
    out = G.criterion_distances(stored_pairs(spark, sf_dir))
    return out.select("clip_id", "skill", "k", "rule_id", "maximum", *R6("distance"))


@query(
    "c08_grade_criteria",
    ctes=(*GRADED, GRADE_SQL),
    sql="SELECT clip_id, CAST(k AS INT) k, rule_id, round(dist,6) distance, round(grade,6) grade, round(tg,6) total_grade FROM g2",
)
def c08(spark, sf_dir):
    _, criteria = G.grade_clips(stored_pairs(spark, sf_dir), calibration(spark))
    return criteria.select("clip_id", "k", "rule_id", *R6("distance", "grade", "total_grade"))


@query(
    "s08_wide_grades",
    ctes=(*GRADED, GRADE_SQL),
    sql="SELECT clip_id, round(any_value(tg),6) total_grade, " + ", ".join(f"round(max(grade) FILTER (k={k}),6) detail_{k+1}_grade, round(max(dist) FILTER (k={k}),6) detail_{k+1}_distance" for k in range(6)) + " FROM g2 GROUP BY 1",
)
def s08(spark, sf_dir):
    totals, criteria = G.grade_clips(stored_pairs(spark, sf_dir), calibration(spark))
    wide = G.wide_grades(totals, criteria)
    names = ["total_grade"] + [f"detail_{k}_{n}" for k in range(1, 7) for n in ("grade", "distance")]
    return wide.select("clip_id", *R6(*names))


PHASE_VALUES = "ph AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}',{k},'{n}',{a},{b})" for s in spec.SKILLS for k, (n, a, b) in enumerate(spec.PHASE_WINDOWS[s])
) + ") v(skill, ord, phase, p0, p1))"
EVIDENCE_SQL = (
    PHASE_VALUES + ", pw AS (SELECT t.*, ph.ord, ph.phase, ph.p0 FROM tm t JOIN ph ON ph.skill = t.skill AND t.frame >= p0 AND t.frame < p1),"
    + _keypoint_sql("kp", "tm", "clip_id, skill") + ","
    + _keypoint_sql("pk", "pw", "clip_id, skill, ord, phase", "frame > p0") + f""",
pk2 AS (SELECT *, {TOTAL} d FROM pk WHERE joint NOT BETWEEN 1 AND 4),
worst AS (SELECT clip_id, joint, arg_min(phase, struct_pack(d := -d, o := ord)) worst_phase FROM pk2 GROUP BY 1, 2),
vec AS (SELECT p.clip_id, p.joint, ph.phase, {", ".join(f"CASE WHEN sum(c) > 1e-8 THEN sum((t{x}-s{x})*c)/sum(c) ELSE 0 END v{x}" for x in "xyz")}
   FROM pr p JOIN ph ON ph.skill = p.skill AND p.frame >= p0 AND p.frame < p1 GROUP BY 1,2,3),
ev AS (SELECT k.clip_id, k.skill, CAST(k.joint AS INT) joint, {TOTAL} dist, pos, ang, vel, bone, w importance, worst_phase, vx, vy, vz,
   100 * exp(-alpha * greatest(({TOTAL}) - o, 0)) score
   FROM kp k JOIN worst USING (clip_id, joint) JOIN vec v ON v.clip_id = k.clip_id AND v.joint = k.joint AND v.phase = worst_phase
   JOIN jw ON jw.skill = k.skill AND jw.joint = k.joint JOIN cal ON cal.skill = k.skill)"""
)
DIRECTION = """CASE WHEN sqrt(vx**2+vy**2+vz**2) < 0.01 THEN 'minimal_change'
WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN CASE WHEN vx > 0 THEN 'toward_dominant_side' ELSE 'toward_non_dominant_side' END
WHEN abs(vy) >= abs(vz) THEN CASE WHEN vy > 0 THEN 'raise' ELSE 'lower' END ELSE CASE WHEN vz > 0 THEN 'forward' ELSE 'backward' END END"""
EVIDENCE = (*BASE, TERM_SQL, CAL_SQL, EVIDENCE_SQL)


def evidence(spark, sf_dir):
    return G.keypoint_evidence(stored_pairs(spark, sf_dir), calibration(spark))


@query(
    "x23_keypoint_evidence",
    ctes=EVIDENCE,
    sql=f"SELECT clip_id, skill, joint, round(score,6) score, round(dist,6) correction_distance, importance importance_weight, worst_phase, {DIRECTION} correction_direction, round(vx,6) vx, round(vy,6) vy, round(vz,6) vz FROM ev",
)
def x23(spark, sf_dir):
    return evidence(spark, sf_dir).select("clip_id", "skill", "joint", *R6("score", "correction_distance"), "importance_weight", "worst_phase", "correction_direction", *R6("vx", "vy", "vz"))


@query(
    "t14_worst_phase",
    ctes=EVIDENCE,
    sql="SELECT clip_id, joint, worst_phase, round(m['contact'],6) contact_distance FROM (SELECT ev.clip_id, ev.joint, worst_phase, MAP {'contact': max(d) FILTER (phase = 'contact')} m FROM ev JOIN pk2 USING (clip_id, joint) GROUP BY ALL)",
)
def t14(spark, sf_dir):
    return evidence(spark, sf_dir).select("clip_id", "joint", "worst_phase", F.round(F.col("phase_distances")["contact"], 6).alias("contact_distance"))


@query(
    "t01_priority_corrections",
    ctes=EVIDENCE,
    sql="SELECT clip_id, joint, CAST(rn AS INT) priority FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, importance DESC, joint) rn FROM ev) WHERE rn <= 5",
)
def t01(spark, sf_dir):
    return G.top_corrections(evidence(spark, sf_dir)).select("clip_id", "joint", "priority")


@query(
    "t02_lowest_keypoints",
    ctes=EVIDENCE,
    sql="SELECT clip_id, joint, CAST(rn AS INT) place, round(score,6) score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score, joint) rn FROM ev) WHERE rn <= 8",
)
def t02(spark, sf_dir):
    return G.lowest_keypoints(evidence(spark, sf_dir)).select("clip_id", "joint", "place", *R6("score"))
