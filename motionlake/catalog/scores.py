"""Queries over graded clips: calibration, cohorts, joins, selection, comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motionlake import spec
from motionlake.catalog.poses import R6
from motionlake.catalog.registry import query
from motionlake.catalog.views import CANDIDATE_SQL, GRADED_SQL, POSE_SQL, candidates, graded, pose_frames, table
from motionlake.functions import columns as C
from motionlake.operators import evaluate as E
from motionlake.operators import grading as G
from motionlake.operators import paging
from motionlake.operators import sampling as S
from motionlake.session import scratch_folder

CALIBRATE_SQL = """
be AS (SELECT skill, correction_distance d, count(*) n FROM graded WHERE label = 'beginners' GROUP BY 1, 2),
ex AS (SELECT skill, correction_distance d FROM graded WHERE label = 'experts'),
offs AS (SELECT DISTINCT skill, o FROM (
   SELECT skill, unnest(quantile_cont(d, [i / 200.0::DOUBLE FOR i IN range(201)])) o FROM ex GROUP BY skill
   UNION ALL SELECT DISTINCT skill, 0.0::DOUBLE FROM ex)),
mean0 AS (SELECT f.skill, f.o, sum(n) tn, sum(CASE WHEN d <= o THEN n ELSE 0 END) z FROM offs f JOIN be USING (skill) GROUP BY 1, 2),
fit AS (
  SELECT skill, o, 0 AS step, 0.0::DOUBLE lo, 1.0::DOUBLE hi, true AS growing FROM offs
  UNION ALL
  SELECT f.skill, f.o, f.step + 1,
    CASE WHEN NOT any_value(f.growing) AND {mean} > {target} THEN any_value((f.lo + f.hi) / 2) ELSE any_value(f.lo) END,
    CASE WHEN any_value(f.growing) THEN CASE WHEN {mean} > {target} AND any_value(f.hi) < 1e6 THEN any_value(f.hi) * 2 ELSE any_value(f.hi) END
         WHEN {mean} > {target} THEN any_value(f.hi) ELSE any_value((f.lo + f.hi) / 2) END,
    any_value(f.growing) AND {mean} > {target} AND any_value(f.hi) < 1e6
  FROM fit f JOIN be b ON b.skill = f.skill WHERE f.step < 82 GROUP BY f.skill, f.o, f.step),
alpha AS (SELECT skill, o, (lo + hi) / 2 a FROM fit WHERE step = 82),
bm AS (SELECT a.skill, a.o, a.a, sum(n * 100 * exp(-a.a * greatest(d - a.o, 0))) / sum(n) m FROM alpha a JOIN be USING (skill) GROUP BY 1,2,3),
em AS (SELECT a.skill, a.o, avg(100 * exp(-a.a * greatest(d - a.o, 0))) m FROM alpha a JOIN ex USING (skill) GROUP BY 1,2),
obj AS (SELECT bm.skill, bm.o, bm.a, abs(em.m - {expert}) + abs(bm.m - {target}) + CASE WHEN 100.0 * z / tn > {target} THEN 100 ELSE 0 END f,
  100.0 * z / tn <= {target} ok FROM bm JOIN em USING (skill, o) JOIN mean0 USING (skill, o)),
calib AS (SELECT skill, arg_min(struct_pack(o := o, a := a, ok := ok), struct_pack(f := f, o := o)) b FROM obj GROUP BY skill)"""
_MEAN = "(sum(b.n * 100 * exp(-(CASE WHEN f.growing THEN f.hi ELSE (f.lo + f.hi) / 2 END) * greatest(b.d - f.o, 0))) / sum(b.n))"


def _calibrate_sql(target: str, expert: str) -> str:
    return CALIBRATE_SQL.format(mean=_MEAN, target=target, expert=expert)


@query(
    "c09_fit_calibration",
    ctes=("RECURSIVE " + GRADED_SQL.strip(), _calibrate_sql("45", "99")),
    sql="SELECT skill, round(b.o, 6) distance_offset, round(b.a, 5) alpha, b.ok target_reachable FROM calib",
)
def c09(spark, sf_dir):
    out = G.fit_calibration(graded(spark, sf_dir))
    return out.select("skill", *R6("distance_offset"), F.round("alpha", 5).alias("alpha"), "target_reachable")


@query(
    "c09_fit_calibration_report_target",
    ctes=("RECURSIVE " + GRADED_SQL.strip(), _calibrate_sql("45", "99.8")),
    sql="SELECT skill, round(b.o, 6) distance_offset, round(b.a, 5) alpha, b.ok target_reachable FROM calib",
)
def c09_report(spark, sf_dir):
    out = G.fit_calibration(graded(spark, sf_dir), target_expert=99.8)
    return out.select("skill", *R6("distance_offset"), F.round("alpha", 5).alias("alpha"), "target_reachable")


@query(
    "x07_calibrated_score",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, round(100 * exp(-3.2::DOUBLE * greatest(correction_distance - CASE skill WHEN 'serve' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END, 0)), 6) score FROM graded",
)
def x07(spark, sf_dir):
    offset = F.when(F.col("skill") == "serve", 0.4).otherwise(0.3)
    return graded(spark, sf_dir).select("clip_id", F.round(C.score(F.col("correction_distance"), offset, F.lit(3.2)), 6).alias("score"))


CRITERIA_VALUES = "cr AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}',{k},{r[3]}::DOUBLE)" for s in spec.SKILLS for k, r in enumerate(spec.RULES[s])
) + ") v(skill, k, mx))"


@query(
    "x11_reconcile_criteria",
    ctes=(GRADED_SQL, CRITERIA_VALUES, """
a AS (SELECT clip_id, k, mx, total_grade, mx * ((clip_id * 13 + k * 29) % 101) / 100.0::DOUBLE g FROM graded JOIN cr USING (skill)),
b AS (SELECT *, sum(g) OVER (PARTITION BY clip_id) raw, sum(mx - g) OVER (PARTITION BY clip_id) room FROM a)"""),
    sql="""SELECT clip_id, CAST(k AS INT) k, round(CASE WHEN raw > total_grade AND raw > 1e-8 THEN g * total_grade / raw WHEN raw < total_grade AND room > 1e-8 THEN g + (total_grade - raw) * (mx - g) / room ELSE g END, 6) grade FROM b""",
)
def x11(spark, sf_dir):
    rows = graded(spark, sf_dir).join(F.broadcast(spec.criteria(spark)), "skill")
    share = (F.col("clip_id") * 13 + F.col("k") * 29) % 101
    rows = rows.withColumn("grade", F.col("maximum") * share / 100.0)
    return G.reconcile(rows).select("clip_id", "k", *R6("grade"))


SUMMARY_SQL = """
have AS (SELECT skill, bool_or(label='experts' AND split='test') xt, bool_or(label='experts' AND split='validation') xv, bool_or(label='beginners' AND split='test') bt FROM graded GROUP BY 1),
mk AS (SELECT g.*, label='experts' AND CASE WHEN xt THEN split='test' WHEN xv THEN split='validation' ELSE true END ref,
   label='beginners' AND CASE WHEN bt THEN split='test' ELSE true END cmp FROM graded g JOIN have USING (skill)),
lim AS (SELECT skill, min(total_grade) gmin, max(correction_distance) dmax FROM mk WHERE ref GROUP BY 1),
rk AS (SELECT skill, label, rank() OVER (PARTITION BY skill ORDER BY correction_distance) + (count(*) OVER (PARTITION BY skill, correction_distance) - 1) / 2.0::DOUBLE r FROM mk WHERE ref OR cmp),
auc AS (SELECT skill, (sum(r) FILTER (label='beginners') - nb * (nb + 1) / 2.0::DOUBLE) / (nb * ne) auc FROM (
   SELECT *, count(*) FILTER (label='beginners') OVER (PARTITION BY skill) nb, count(*) FILTER (label='experts') OVER (PARTITION BY skill) ne FROM rk) GROUP BY skill, nb, ne),
gr AS (SELECT *, label grp FROM mk UNION ALL SELECT *, label || '_validation' FROM mk WHERE split='validation'
   UNION ALL SELECT *, 'experts_test' FROM mk WHERE label='experts' AND split='test' UNION ALL SELECT *, 'beginners_test' FROM mk WHERE cmp)"""


@query(
    "a14_cohort_summary",
    ctes=(GRADED_SQL, SUMMARY_SQL),
    sql="""SELECT skill, grp AS "group", count(*) "count", round(avg(total_grade),6) mean, round(median(total_grade),6) median, round(min(total_grade),6) "min", round(max(total_grade),6) "max",
round(CASE WHEN grp='beginners' THEN avg(CASE WHEN total_grade >= gmin THEN 1.0::DOUBLE ELSE 0 END) ELSE 0 END,6) overlap, round(avg(correction_distance),6) correction_distance_mean, round(median(correction_distance),10) correction_distance_median,
round(CASE WHEN grp='beginners' THEN avg(CASE WHEN correction_distance <= dmax THEN 1.0::DOUBLE ELSE 0 END) ELSE 0 END,6) distance_overlap, round(any_value(auc),6) separation_auc
FROM gr JOIN lim USING (skill) JOIN auc USING (skill) GROUP BY 1, 2""",
)
def a14(spark, sf_dir):
    out = G.cohort_summary(graded(spark, sf_dir))
    return out.select("skill", "group", "count", *R6("mean", "median", "min", "max", "overlap", "correction_distance_mean"),
                      F.round("correction_distance_median", 10).alias("correction_distance_median"), *R6("distance_overlap", "separation_auc"))


@query(
    "a15_separation_auc",
    ctes=(GRADED_SQL, """
part AS (SELECT g.*, unnest(['all', split]) part FROM graded g),
rk AS (SELECT skill, part, label, rank() OVER (PARTITION BY skill, part ORDER BY correction_distance) + (count(*) OVER (PARTITION BY skill, part, correction_distance) - 1) / 2.0::DOUBLE r FROM part)"""),
    sql="""SELECT skill, part, round((sum(r) FILTER (label='beginners') - nb * (nb + 1) / 2.0::DOUBLE) / (nb * ne), 6) auc FROM (
SELECT *, count(*) FILTER (label='beginners') OVER (PARTITION BY skill, part) nb, count(*) FILTER (label='experts') OVER (PARTITION BY skill, part) ne FROM rk) GROUP BY skill, part, nb, ne""",
)
def a15(spark, sf_dir):
    """Both cohorts whole, and every split of them."""
    rows = graded(spark, sf_dir).withColumn("part", F.explode(F.array(F.lit("all"), F.col("split"))))
    out = G.separation_auc(rows, "correction_distance", F.col("label") == "beginners", ["skill", "part"])
    return out.select("skill", "part", *R6("auc"))


@query(
    "a16_roc_auc",
    ctes=(GRADED_SQL, CANDIDATE_SQL, "rk AS (SELECT candidate, label, rank() OVER (PARTITION BY candidate ORDER BY -total_grade) + (count(*) OVER (PARTITION BY candidate, total_grade) - 1) / 2.0::DOUBLE r FROM cand)"),
    sql="SELECT candidate, round((sum(r) FILTER (label='beginners') - nb * (nb + 1) / 2.0::DOUBLE) / (nb * ne), 6) auc FROM (SELECT *, count(*) FILTER (label='beginners') OVER (PARTITION BY candidate) nb, count(*) FILTER (label='experts') OVER (PARTITION BY candidate) ne FROM rk) GROUP BY candidate, nb, ne",
)
def a16(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("v", -F.col("total_grade"))
    return G.separation_auc(rows, "v", F.col("label") == "beginners", ["candidate"]).select("candidate", *R6("auc"))


RANK = "rank() OVER (PARTITION BY candidate, skill ORDER BY {c}) + (count(*) OVER (PARTITION BY candidate, skill, {c}) - 1) / 2.0::DOUBLE"


@query(
    "a17_spearman",
    ctes=(GRADED_SQL, CANDIDATE_SQL, f"rk AS (SELECT candidate, skill, {RANK.format(c='total_grade')} a, {RANK.format(c='correction_distance')} b FROM cand)"),
    sql="SELECT candidate, skill, round(corr(a, b), 6) spearman FROM rk GROUP BY 1, 2",
)
def a17(spark, sf_dir):
    return E.spearman(candidates(spark, sf_dir), "total_grade", "correction_distance", ["candidate", "skill"]).select("candidate", "skill", *R6("spearman"))


@query(
    "a18_group_means",
    ctes=(GRADED_SQL,),
    sql="SELECT skill, CASE WHEN label='beginners' THEN 'students' ELSE label END AS \"group\", count(*) clip_count, round(avg(total_grade),6) total_score, round(avg(correction_distance),6) correction_distance FROM graded GROUP BY 1, 2",
)
def a18(spark, sf_dir):
    means = G.group_means(G.export_scores(graded(spark, sf_dir)), ["total_score", "correction_distance"], ["skill", "group"])
    return means.select("skill", "group", "clip_count", *R6("total_score", "correction_distance"))


@query(
    "c11_export_scores",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, filename, skill, CASE WHEN label='beginners' THEN 'students' ELSE label END AS \"group\", handedness, round(total_grade,6) total_score, correction_distance FROM graded WHERE clip_id % 9 > 0",
)
def c11(spark, sf_dir):
    rows = graded(spark, sf_dir).withColumn("status", F.when(F.col("clip_id") % 9 == 0, "error").otherwise("success"))
    return G.export_scores(rows).select("clip_id", "filename", "skill", "group", "handedness", *R6("total_score"), "correction_distance")


@query("x22_label_recode", ctes=(GRADED_SQL,), sql="SELECT CASE WHEN label='beginners' THEN 'students' ELSE label END AS \"group\", count(*) n FROM graded GROUP BY 1")
def x22(spark, sf_dir):
    return G.export_scores(graded(spark, sf_dir)).groupBy("group").agg(F.count("*").alias("n"))


@query("s09_compact_grades", ctes=(GRADED_SQL,), sql="SELECT 'clip_' || clip_id subject_name, filename, label AS \"group\", round(total_grade,6) grade FROM graded")
def s09(spark, sf_dir):
    return G.compact_grades(graded(spark, sf_dir)).withColumn("grade", F.round("grade", 6))


@query("a24_inventory", ctes=(GRADED_SQL,), sql="""SELECT skill, count(*) FILTER (handedness='right') AS "right", count(*) FILTER (handedness='left') AS "left", count(*) total FROM graded GROUP BY 1""")
def a24(spark, sf_dir):
    return G.inventory(graded(spark, sf_dir))


@query("p17_skill_isolation", ctes=(GRADED_SQL,), sql="SELECT clip_id, skill FROM graded WHERE skill <> 'clear'")
def p17(spark, sf_dir):
    return G.foreign_skill(graded(spark, sf_dir), "clear").select("clip_id", "skill")


@query(
    "p24_finite_summary",
    ctes=(GRADED_SQL, "v AS (SELECT skill, CASE WHEN clip_id % 7 = 0 THEN NULL ELSE correction_distance END d FROM graded)"),
    sql="SELECT skill, round(avg(d),6) mean, round(quantile_cont(d, 0.95),8) p95 FROM v GROUP BY 1",
)
def p24(spark, sf_dir):
    k = F.col("clip_id")
    bad = F.when(k % 14 == 0, float("nan")).when(k % 7 == 0, float("inf")).otherwise(F.col("correction_distance"))
    rows = graded(spark, sf_dir).select("skill", C.finite(bad).alias("d"))
    from motionlake.functions.ordered import exact_percentiles

    p95 = exact_percentiles(rows, ["skill"], "d", {"p95": 0.95})
    return rows.groupBy("skill").agg(F.round(F.avg("d"), 6).alias("mean")).join(p95, "skill").withColumn("p95", F.round("p95", 8))


@query(
    "p25_expert_source_boundary",
    ctes=(GRADED_SQL, "pa AS (SELECT clip_id, '/data/' || skill || CASE WHEN clip_id % 5 = 0 THEN '/old/' ELSE '/' END || CASE WHEN clip_id % 7 = 0 THEN 'legacy' ELSE handedness END || '/' || filename p, skill FROM graded)"),
    sql="SELECT clip_id, skill FROM pa WHERE regexp_matches(p, '^/data/' || skill || '/(left|right)/[^/]+$') AND p NOT LIKE '%/serve/left/%'",
)
def p25(spark, sf_dir):
    from motionlake.sources.archives import expert_sources

    k = F.col("clip_id")
    path = F.concat(
        F.lit("/data/"), F.col("skill"), F.when(k % 5 == 0, "/old/").otherwise("/"),
        F.when(k % 7 == 0, "legacy").otherwise(F.col("handedness")), F.lit("/"), F.col("filename"),
    )
    rows = graded(spark, sf_dir).withColumn("path", path)
    return expert_sources(rows, "/data", exclude=("/data/serve/left",)).select("clip_id", "skill")


# --- joins --------------------------------------------------------------------------


@query(
    "j07_score_changes",
    ctes=(GRADED_SQL,),
    sql="""SELECT g.filename, g.label, round(g.total_grade,6) new_total_grade, round(o.total_grade * 0.5::DOUBLE,6) old_total_grade, round(g.total_grade - o.total_grade * 0.5::DOUBLE,6) score_delta
FROM graded g LEFT JOIN (SELECT * FROM graded WHERE clip_id % 3 > 0) o USING (filename, label)""",
)
def j07(spark, sf_dir):
    rows = graded(spark, sf_dir)
    old = rows.where("clip_id % 3 > 0").withColumn("total_grade", F.col("total_grade") * 0.5)
    return G.score_changes(rows, old).select("filename", "label", *R6("new_total_grade", "old_total_grade", "score_delta"))


@query(
    "j08_single_grade",
    ctes=("l AS (SELECT l_orderkey filename, l_returnflag label, count(*) n, any_value(l_quantity) q FROM lineitem GROUP BY 1, 2)",),
    sql="""SELECT o_orderkey filename, 'A' label, CASE WHEN n = 1 THEN q END score, CASE WHEN n = 1 THEN 'success' ELSE 'error' END status,
CASE WHEN n = 1 THEN '' ELSE 'expected one grade row, found ' || coalesce(n, 0) END error FROM orders LEFT JOIN l ON l.filename = o_orderkey AND l.label = 'A'""",
)
def j08(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filename"), F.lit("A").alias("label"))
    grades = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filename"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("total_grade"))
    return G.single_grade(requests, grades)


@query(
    "j09_preferred_grade",
    ctes=("l AS (SELECT l_orderkey filename, CASE WHEN l_returnflag = 'R' THEN 'beginners' ELSE 'experts' END label, l_linenumber * 100000 + l_partkey line, l_quantity q FROM lineitem)",),
    sql="SELECT filename, label, line, q FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY label = 'beginners' DESC, line, q) rn FROM l) WHERE rn = 1",
)
def j09(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("filename"),
        F.when(F.col("l_returnflag") == "R", "beginners").otherwise("experts").alias("label"),
        (F.col("l_linenumber") * F.lit(100000) + F.col("l_partkey")).alias("line"),
        F.col("l_quantity").alias("q"),
    )
    return G.preferred_grade(rows, "line")


@query(
    "j12_split_membership",
    ctes=(GRADED_SQL, """
sp AS (SELECT filename, label, 'training' s, 2 o FROM graded WHERE clip_id % 2 = 0 UNION ALL SELECT filename, label, 'test', 1 FROM graded WHERE clip_id % 3 = 0
 UNION ALL SELECT filename, label, 'validation', 0 FROM graded WHERE clip_id % 5 = 0 UNION ALL SELECT filename, label, 'validation', 3 FROM graded WHERE clip_id % 7 = 0 AND label = 'experts')"""),
    sql="SELECT g.clip_id, coalesce(m.s, 'evaluation') evaluation_split FROM graded g LEFT JOIN (SELECT filename, label, arg_min(s, o) s FROM sp GROUP BY 1, 2) m USING (filename, label)",
)
def j12(spark, sf_dir):
    rows = graded(spark, sf_dir)
    k = F.col("clip_id")
    names = F.array_compact(F.array(
        F.when(k % 2 == 0, "training"), F.when(k % 3 == 0, "test"), F.when(k % 5 == 0, "validation"), F.when(k % 7 == 0, "legacy_validation")))
    splits = rows.select("filename", "label", F.explode(names).alias("split"))
    return G.evaluation_split(rows, splits).select("clip_id", "evaluation_split")


@query(
    "j10_candidate_status",
    ctes=(GRADED_SQL, CANDIDATE_SQL),
    sql="""SELECT g.clip_id, CAST(k AS INT) candidate, g.skill, CASE WHEN c.clip_id IS NULL THEN 'missing' ELSE 'success' END status, round(abs(c.total_grade - g.total_grade),6) total_score_absolute_error
FROM graded g CROSS JOIN (SELECT unnest([1,2,3]) k) q LEFT JOIN cand c ON c.clip_id = g.clip_id AND c.candidate = k""",
)
def j10(spark, sf_dir):
    return _compared(spark, sf_dir).select(
        "clip_id", "candidate", "skill", "status", F.round(F.abs(F.col("own") - F.col("total_grade")), 6).alias("total_score_absolute_error")
    )


def _compared(spark, sf_dir):
    found = candidates(spark, sf_dir).select("clip_id", "candidate", F.col("total_grade").alias("own"), "shift")
    return E.with_status(graded(spark, sf_dir), found, ["clip_id"], (1, 2, 3))


ANCHOR_AGREE_SQL = """
fs AS (SELECT c.clip_id, c.candidate, c.skill, c.shift h, c.clip_id % 13 s, c.clip_id % 13 + c.clip_id % 17 p, c.clip_id % 13 + c.clip_id % 17 + c.clip_id % 19 + 1 e,
   CASE WHEN c.clip_id % 2 = 0 THEN 25.0::DOUBLE ELSE 60.0::DOUBLE END fps FROM cand c),
fp AS (SELECT *, unnest([s + h, (s+h+p)//2, p, (p+e+2*h)//2, e + 2*h]) a, unnest([s, (s+p)//2, p, (p+e)//2, e]) b FROM fs),
fr AS (SELECT clip_id, candidate, skill, avg(abs(a-b)) mae, avg(abs(a-b)) * 1000.0::DOUBLE / fps ms, avg(CASE WHEN abs(a-b) <= greatest(1, round_even(fps*0.1::DOUBLE, 0)) THEN 1.0::DOUBLE ELSE 0 END) rec,
   greatest(0, least(e+2*h, e) - greatest(s+h, s) + 1) / greatest(1, greatest(e+2*h, e) - least(s+h, s) + 1)::DOUBLE iou FROM fp GROUP BY clip_id, candidate, skill, fps, s, p, e, h)"""


def _agreement(spark, sf_dir):
    k, h = F.col("clip_id"), F.col("shift")
    s, p, e = k % 13, k % 13 + k % 17, k % 13 + k % 17 + k % 19 + 1
    middle = lambda a, b: F.floor((a + b) / 2)
    own = F.array(s + h, middle(s + h, p), p, middle(p, e + 2 * h), e + 2 * h)
    reference = F.array(s, middle(s, p), p, middle(p, e), e)
    fps = F.when(k % 2 == 0, 25.0).otherwise(60.0)
    rows = _compared(spark, sf_dir)
    return rows.withColumns(
        {**E.anchor_agreement(own, reference, fps), "window_iou": E.interval_iou(s + h, e + 2 * h, s, e)}
    )


@query(
    "a20_anchor_agreement",
    ctes=(GRADED_SQL, CANDIDATE_SQL, ANCHOR_AGREE_SQL),
    sql="SELECT clip_id, candidate, round(mae,6) checkpoint_mae_frames, round(ms,6) checkpoint_mae_milliseconds, round(rec,6) checkpoint_recall_100ms, round(iou,6) window_iou FROM fr",
)
def a20(spark, sf_dir):
    return _agreement(spark, sf_dir).where("status = 'success'").select("clip_id", "candidate", *R6("checkpoint_mae_frames", "checkpoint_mae_milliseconds", "checkpoint_recall_100ms", "window_iou"))


@query(
    "x12_interval_iou",
    ctes=("w AS (SELECT o_orderkey clip_id, o_orderkey % 17 a0, o_orderkey % 17 + o_orderkey % 11 a1, o_orderkey % 23 b0, o_orderkey % 23 + o_orderkey % 7 b1 FROM orders)",),
    sql="SELECT clip_id, round(greatest(0, least(a1, b1) - greatest(a0, b0) + 1) / greatest(1, greatest(a1, b1) - least(a0, b0) + 1)::DOUBLE, 6) iou FROM w",
)
def x12(spark, sf_dir):
    k = F.col("o_orderkey")
    a0, b0 = k % 17, k % 23
    return table(spark, sf_dir, "orders").select(k.alias("clip_id"), F.round(E.interval_iou(a0, a0 + k % 11, b0, b0 + k % 7), 6).alias("iou"))


METRICS = ("checkpoint_mae_frames", "checkpoint_recall_100ms", "window_iou")


@query(
    "c13_compare_sources",
    ctes=(GRADED_SQL, CANDIDATE_SQL, ANCHOR_AGREE_SQL, """
al AS (SELECT CAST(k AS INT) candidate, g.skill, g.clip_id, f.mae, f.rec, f.iou, f.clip_id IS NOT NULL ok FROM graded g CROSS JOIN (SELECT unnest([1,2,3]) k) q LEFT JOIN fr f ON f.clip_id = g.clip_id AND f.candidate = k),
bo AS (SELECT * FROM al UNION ALL SELECT candidate, 'all', clip_id, mae, rec, iou, ok FROM al),
ct AS (SELECT candidate, skill, count(*) FILTER (ok) samples, count(*) FILTER (NOT ok) failures FROM bo GROUP BY 1, 2),
lo AS (SELECT candidate, skill, 'checkpoint_mae_frames' metric, mae v FROM bo WHERE ok UNION ALL SELECT candidate, skill, 'checkpoint_recall_100ms', rec FROM bo WHERE ok UNION ALL SELECT candidate, skill, 'window_iou', iou FROM bo WHERE ok)"""),
    sql="SELECT candidate, skill, samples, failures, metric, round(avg(v),6) mean, round(quantile_cont(v,0.95),6) p95 FROM lo JOIN ct USING (candidate, skill) GROUP BY ALL",
)
def c13(spark, sf_dir):
    out = E.metric_summary(_agreement(spark, sf_dir), METRICS)
    return out.select("candidate", "skill", "samples", "failures", "metric", *R6("mean", "p95"))


GRADE_AGREE_SQL = """
gs AS (SELECT c.candidate, c.skill, c.label, c.clip_id, c.total_grade ts, g.total_grade os, abs(c.shift - 3) / 4.0::DOUBLE ce, CASE WHEN c.label='beginners' AND c.clip_id % 6 = 0 THEN 'calibration' ELSE 'test' END sp FROM cand c JOIN graded g USING (clip_id)),
gb AS (SELECT * FROM gs UNION ALL SELECT * REPLACE ('all' AS skill) FROM gs),
gt AS (SELECT * FROM gb WHERE sp = 'test'),
gk AS (SELECT *, rank() OVER (PARTITION BY candidate, skill ORDER BY ts) + (count(*) OVER (PARTITION BY candidate, skill, ts) - 1)/2.0::DOUBLE ra, rank() OVER (PARTITION BY candidate, skill ORDER BY os) + (count(*) OVER (PARTITION BY candidate, skill, os) - 1)/2.0::DOUBLE rb,
   rank() OVER (PARTITION BY candidate, skill ORDER BY -ts) + (count(*) OVER (PARTITION BY candidate, skill, ts) - 1)/2.0::DOUBLE rn FROM gt),
gm AS (SELECT candidate, skill, avg(ts) cm FROM gb WHERE sp='calibration' GROUP BY 1, 2)"""


@query(
    "a22_grading_summary",
    ctes=(GRADED_SQL, CANDIDATE_SQL, GRADE_AGREE_SQL),
    sql="""SELECT candidate, skill, count(*) test_samples, count(*) FILTER (label='experts') test_experts, count(*) FILTER (label='beginners') test_beginners, round(avg(abs(ts-os)),6) total_score_mae, round(avg(ce),6) criterion_score_mae,
round(corr(ra, rb),6) score_spearman, round((sum(rn) FILTER (label='beginners') - count(*) FILTER (label='beginners') * (count(*) FILTER (label='beginners') + 1) / 2.0::DOUBLE) / (count(*) FILTER (label='beginners') * count(*) FILTER (label='experts')),6) expert_beginner_auc,
round(avg(ts) FILTER (label='experts'),6) expert_score_mean, round(avg(ts) FILTER (label='beginners'),6) beginner_score_mean, round(any_value(cm),6) calibration_beginner_score_mean FROM gk LEFT JOIN gm USING (candidate, skill) GROUP BY 1, 2""",
)
def a22(spark, sf_dir):
    oracle = graded(spark, sf_dir).select("clip_id", F.col("total_grade").alias("oracle_total_score"))
    rows = candidates(spark, sf_dir).join(oracle, "clip_id").select(
        "candidate", "skill", "label", "clip_id", F.col("total_grade").alias("total_score"), "oracle_total_score",
        (F.abs(F.col("shift") - 3) / 4.0).alias("criterion_score_mae"),
        F.when((F.col("label") == "beginners") & (F.col("clip_id") % 6 == 0), "calibration").otherwise("test").alias("split"),
    )
    out = E.grading_summary(rows)
    return out.select("candidate", "skill", "test_samples", "test_experts", "test_beginners",
                      *R6("total_score_mae", "criterion_score_mae", "score_spearman", "expert_beginner_auc", "expert_score_mean", "beginner_score_mean", "calibration_beginner_score_mean"))


@query(
    "a22_expected_counts",
    ctes=(GRADED_SQL,),
    sql="SELECT skill, count(*) expected_evaluation_samples FROM (SELECT skill FROM graded WHERE label='experts' OR clip_id % 6 > 0 UNION ALL SELECT 'all' FROM graded WHERE label='experts' OR clip_id % 6 > 0) GROUP BY 1",
)
def a22_expected(spark, sf_dir):
    rows = graded(spark, sf_dir)
    return E.expected_counts(rows, rows.where("label = 'beginners' AND clip_id % 6 = 0"), ["clip_id"])


@query(
    "x26_criterion_mae",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, round((abs(total_grade * 0.5::DOUBLE - 20) + abs(total_grade * 0.3::DOUBLE - 5) + abs(total_grade * 0.2::DOUBLE - 1)) / 3, 6) criterion_score_mae FROM graded",
)
def x26(spark, sf_dir):
    g = F.col("total_grade")
    err = E.criterion_errors(F.array(g * 0.5, g * 0.3, g * 0.2), F.array(F.lit(20.0), F.lit(5.0), F.lit(1.0)))
    return graded(spark, sf_dir).select("clip_id", F.round(E.array_mean(err), 6).alias("criterion_score_mae"))


@query(
    "a19_correction_summary",
    ctes=(GRADED_SQL, "r AS (SELECT skill, correction_distance i, correction_distance * ((clip_id % 11) / 10.0::DOUBLE) c, (clip_id % 13) / 10.0::DOUBLE m, (clip_id % 17) / 1000.0::DOUBLE b FROM graded)"),
    sql="""SELECT skill, count(*) "count", round(avg(i),6) input_nearest_expert_distance, round(avg(c),6) corrected_nearest_expert_distance, round(avg(c / greatest(i, 1e-8)),6) nearest_distance_ratio,
round(avg(CASE WHEN c < i THEN 1.0::DOUBLE ELSE 0 END),6) improved_fraction, round(avg(CASE WHEN c <= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END),6) within_expert_range_fraction, max(m) max_joint_correction, max(b) p95_relative_bone_change FROM r GROUP BY 1""",
)
def a19(spark, sf_dir):
    out = E.correction_summary(_correction_rows(spark, sf_dir), F.lit(0.2), ["skill"])
    return out.select("skill", "count", *R6("input_nearest_expert_distance", "corrected_nearest_expert_distance", "nearest_distance_ratio", "improved_fraction", "within_expert_range_fraction"), "max_joint_correction", "p95_relative_bone_change")


def _correction_rows(spark, sf_dir):
    k, d = F.col("clip_id"), F.col("correction_distance")
    near = d * ((k % 11) / 10.0)
    return graded(spark, sf_dir).select(
        "clip_id", "skill", d.alias("input_nearest_expert_distance"), near.alias("corrected_nearest_expert_distance"),
        near.alias("corrected_nearest_unseen_expert_distance"), (near / 10).alias("corrected_reference_target_distance"),
        d.alias("input_mean_expert_distance"), near.alias("corrected_mean_expert_distance"),
        ((k % 13) / 10.0).alias("max_joint_correction"), d.alias("mean_correction_acceleration"),
        d.alias("reference_correction_acceleration"), F.lit(1.0).alias("correction_acceleration_ratio"),
        ((k % 17) / 1000.0).alias("p95_relative_bone_change"),
    )


@query(
    "a27_acceptance_gate",
    ctes=(GRADED_SQL, """
m AS (SELECT skill, clip_id epoch, correction_distance d, CASE WHEN clip_id % 5 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END f, (clip_id % 17) / 10.0::DOUBLE mj, (clip_id % 17) / 10000.0::DOUBLE b FROM graded),
a AS (SELECT *, f >= 1 AND d <= 0.4::DOUBLE AND mj <= 0.8::DOUBLE * 1.5::DOUBLE AND b < 1e-3 ok FROM m)"""),
    sql="SELECT skill, epoch, ok accepted, coalesce(epoch = arg_min(epoch, struct_pack(d := d, e := epoch)) FILTER (ok) OVER (PARTITION BY skill), false) best FROM a",
)
def a27(spark, sf_dir):
    k = F.col("clip_id")
    rows = graded(spark, sf_dir).select(
        "skill", k.alias("epoch"), F.col("correction_distance").alias("corrected_nearest_expert_distance"),
        F.when(k % 5 == 0, 0.9).otherwise(1.0).alias("improved_fraction"), F.lit(1.0).alias("within_expert_range_fraction"),
        F.lit(0.05).alias("max_reference_target_distance"), ((k % 17) / 10.0).alias("max_joint_correction"),
        F.lit(1.0).alias("mean_correction_acceleration_ratio"), ((k % 17) / 10000.0).alias("p95_relative_bone_change"), F.lit(0.4).alias("expert_p95"),
    )
    return E.acceptance_gate(rows, by=["skill"]).select("skill", "epoch", "accepted", "best")


@query(
    "a28_runtime_stats",
    sql="SELECT l_returnflag source, round(avg(l_extendedprice / 1000),6) mean_seconds, round(quantile_cont(l_extendedprice / 1000, 0.95),6) p95_seconds, round(sum(l_quantity) / sum(l_extendedprice / 1000),6) fps FROM lineitem GROUP BY 1",
)
def a28(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), (F.col("l_extendedprice") / 1000).alias("seconds"), F.col("l_quantity").alias("frames"))
    return E.runtime_stats(runs, ["source"]).select("source", *R6("mean_seconds", "p95_seconds", "fps"))


# --- selection ----------------------------------------------------------------------


@query(
    "t03_extremes",
    ctes=(GRADED_SQL,),
    sql="""SELECT skill, label, kind, CAST(rn AS INT) place, clip_id FROM (
SELECT *, 'lowest' kind, row_number() OVER (PARTITION BY skill, label ORDER BY total_grade, clip_id) rn FROM graded UNION ALL
SELECT *, 'highest', row_number() OVER (PARTITION BY skill, label ORDER BY total_grade DESC, clip_id) FROM graded) WHERE rn <= 10""",
)
def t03(spark, sf_dir):
    rows = graded(spark, sf_dir)
    low = S.extremes(rows, 10, "total_grade", "clip_id", ["skill", "label"]).withColumn("kind", F.lit("lowest"))
    high = S.extremes(rows, 10, "total_grade", "clip_id", ["skill", "label"], True).withColumn("kind", F.lit("highest"))
    return low.unionByName(high).select("skill", "label", "kind", "place", "clip_id")


@query("t04_lowest_student", ctes=(GRADED_SQL,), sql="SELECT clip_id, filename, round(total_grade,6) total_grade FROM graded WHERE label='beginners' ORDER BY graded.total_grade, clip_id LIMIT 1")
def t04(spark, sf_dir):
    return S.lowest(graded(spark, sf_dir).where("label = 'beginners'"), "total_grade", "clip_id").select("clip_id", "filename", *R6("total_grade"))


@query("t05_seeded_sample", ctes=(GRADED_SQL,), sql="SELECT clip_id, skill FROM graded ORDER BY md5(clip_id || ':2026'), clip_id LIMIT 50")
def t05(spark, sf_dir):
    return S.seeded_sample(graded(spark, sf_dir), 50, 2026).select("clip_id", "skill")


@query(
    "t06_evenly_spaced",
    ctes=(GRADED_SQL, "pl AS (SELECT *, row_number() OVER (PARTITION BY skill, label ORDER BY clip_id) - 1 p, count(*) OVER (PARTITION BY skill, label) n, CASE WHEN label='beginners' THEN 8 ELSE 12 END k FROM graded)"),
    sql="SELECT skill, label, clip_id FROM pl WHERE list_contains([CAST(round_even(i * (n-1) / (k-1)::DOUBLE, 0) AS BIGINT) FOR i IN range(k)], p)",
)
def t06(spark, sf_dir):
    k = F.when(F.col("label") == "beginners", 8).otherwise(12)
    return S.evenly_spaced(graded(spark, sf_dir), k, ["skill", "label"]).select("skill", "label", "clip_id")


@query(
    "t07_natural_order",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, CAST(row_number() OVER (PARTITION BY skill, clip_id % 2 ORDER BY clip_id) - 1 AS INT) place FROM graded",
)
def t07(spark, sf_dir):
    k = F.col("clip_id")
    name = F.concat(F.when(k % 4 < 2, "Clip").otherwise("cLIP"), F.col("clip_id").cast("string"), F.lit("b.mp4"))
    rows = graded(spark, sf_dir).withColumns({"name": name, "half": k % 2})
    return S.natural_positions(rows, ["skill", "half"], "name").select("clip_id", "place")


SPLIT_SQL = """
sh AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(clip_id || ':7'), clip_id) - 1 p, count(*) OVER (PARTITION BY {by}) n FROM graded)"""
SPLIT_CASE = "CASE WHEN p < greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' WHEN p < greatest(1, round_even(n * 0.2::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'validation' ELSE 'training' END"


@query("t08_split", ctes=(GRADED_SQL, SPLIT_SQL.format(by="skill")), sql=f"SELECT clip_id, {SPLIT_CASE} AS split FROM sh")
def t08(spark, sf_dir):
    return S.split(graded(spark, sf_dir), 7, group=["skill"]).select("clip_id", "split")


@query("t09_stratified_split", ctes=(GRADED_SQL, SPLIT_SQL.format(by="skill, handedness")), sql=f"SELECT clip_id, handedness, {SPLIT_CASE} AS split FROM sh")
def t09(spark, sf_dir):
    return S.split(graded(spark, sf_dir), 7, stratify=["handedness"], group=["skill"]).select("clip_id", "handedness", "split")


@query(
    "u07_split_complement",
    ctes=(GRADED_SQL, SPLIT_SQL.format(by="skill"), f"s AS (SELECT clip_id, {SPLIT_CASE} sp FROM sh)"),
    sql="SELECT clip_id FROM s WHERE sp = 'training'",
)
def u07(spark, sf_dir):
    rows = graded(spark, sf_dir)
    held = S.split(rows, 7, group=["skill"]).where("split IN ('test', 'validation')")
    return rows.select("clip_id").join(held, "clip_id", "left_anti")


@query("t10_calibration_subset", ctes=(GRADED_SQL,), sql="SELECT skill, clip_id, CAST(rn AS INT) place FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY clip_id) rn FROM graded WHERE label='beginners') WHERE rn <= 4")
def t10(spark, sf_dir):
    rows = graded(spark, sf_dir).where("label = 'beginners'")
    return S.first_k(rows, 4, ["skill"], [C.natural_key(F.col("filename")), F.col("filename")]).select("skill", "clip_id", "place")


@query(
    "t11_roles",
    ctes=(GRADED_SQL,),
    sql="SELECT skill, clip_id, CASE WHEN (row_number() OVER (PARTITION BY skill ORDER BY clip_id) - 1) % 3 <> 2 THEN 'reference' ELSE 'evaluation' END AS role FROM graded WHERE label='experts'",
)
def t11(spark, sf_dir):
    return S.assign_roles(graded(spark, sf_dir).where("label = 'experts'"), ["skill"]).select("skill", "clip_id", "role")


MANIFEST_SQL = """
pl AS (SELECT *, row_number() OVER (PARTITION BY skill, label ORDER BY clip_id) - 1 p, count(*) OVER (PARTITION BY skill, label) n, CASE WHEN label='beginners' THEN 8 ELSE 12 END k FROM graded),
ch AS (SELECT * FROM pl WHERE list_contains([CAST(round_even(i * (n-1) / (k-1)::DOUBLE, 0) AS BIGINT) FOR i IN range(k)], p) OR (clip_id IN (28, 32, 29) AND label = 'beginners')),
mf AS (SELECT *, row_number() OVER (PARTITION BY skill, label ORDER BY clip_id) - 1 q FROM ch)"""


@query(
    "t16_cohort_manifest",
    ctes=(GRADED_SQL, MANIFEST_SQL),
    sql="""SELECT skill, label, clip_id, CASE WHEN label='experts' AND q % 3 <> 2 THEN 'reference' ELSE 'evaluation' END AS role,
CASE clip_id % 3 WHEN 0 THEN '/m/' || clip_id || '.mp4' WHEN 1 THEN '/m/' || clip_id || '.mov' END path, CASE WHEN clip_id % 3 = 2 THEN 'no unique media file' ELSE '' END error FROM mf""",
)
def t16(spark, sf_dir):
    rows = graded(spark, sf_dir).select("skill", "label", "clip_id")
    required = rows.where("clip_id IN (28, 29, 32) AND label = 'beginners'")
    k = F.col("clip_id")
    kinds = F.when(k % 3 == 0, F.array(F.lit(".mp4"), F.lit(".avi"))).when(k % 3 == 1, F.array(F.lit(".mov"))).otherwise(F.array(F.lit(".mov"), F.lit(".avi")))
    media = rows.withColumn("ext", F.explode(kinds)).select("skill", "label", "clip_id", F.concat(F.lit("/m/"), k.cast("string"), F.col("ext")).alias("path"), (F.col("ext") == ".mp4").alias("exact"))
    out = S.build_manifest(rows, {"beginners": 8, "experts": 12}, required, media, subject="clip_id")
    return out.select("skill", "label", "clip_id", "role", "path", "error")


@query(
    "j16_required_union",
    ctes=(GRADED_SQL, MANIFEST_SQL),
    sql="SELECT skill, label, clip_id FROM ch",
)
def j16(spark, sf_dir):
    rows = graded(spark, sf_dir).select("skill", "label", "clip_id")
    chosen = S.evenly_spaced(rows, F.when(F.col("label") == "beginners", 8).otherwise(12), ["skill", "label"]).drop("place")
    return chosen.union(rows.where("clip_id IN (28, 29, 32) AND label = 'beginners'")).distinct()


@query("t12_page", ctes=(GRADED_SQL,), sql="SELECT clip_id, skill FROM graded ORDER BY clip_id LIMIT 200 OFFSET 400")
def t12(spark, sf_dir):
    return S.page(graded(spark, sf_dir), ["clip_id"], 599).select("clip_id", "skill")


@query("t12_stored_page", ctes=(GRADED_SQL,), sql="SELECT clip_id, skill, round(correction_distance, 9) d FROM graded ORDER BY correction_distance, clip_id LIMIT 200 OFFSET 600")
def t12_stored(spark, sf_dir):
    """The fourth page of the clips by distance, from an index with some thousand rows a partition."""
    path = f"{scratch_folder(spark)}/pages-{uuid.uuid4().hex}"
    rows = graded(spark, sf_dir).select("clip_id", "skill", "correction_distance")
    paging.write_pages(rows, ["correction_distance", "clip_id"], path, 5000)
    return paging.read_page(spark, path, 799).select("clip_id", "skill", F.round("correction_distance", 9).alias("d"))


_UNIT = "((('0x' || substr(md5({k} || '#{s}'), 1, 12))::UBIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"
AUGMENT_SQL = f"""
cl AS (SELECT DISTINCT clip_id, '2718/' || clip_id key, max(frame) OVER (PARTITION BY clip_id) last FROM pose),
dr AS (SELECT *, 0.02::DOUBLE + 0.08::DOUBLE * {_UNIT.format(k='key', s='mask')} rate, CAST(floor({_UNIT.format(k='key', s='shift')} * 5) - 2 AS INT) sh FROM cl),
au AS (SELECT d.clip_id, CAST(g AS INT) frame, p.joint, CASE WHEN {_UNIT.format(k="(key || '/' || p.frame || '/' || p.joint)", s='drop')} < rate THEN 0.0::DOUBLE ELSE p.conf END conf
  FROM dr d, (SELECT unnest(range(0, 10)) g) q, pose p WHERE g <= last AND p.clip_id = d.clip_id AND p.frame = greatest(0, least(last, g - sh)))"""


def _normal_sql(key: str, axis: str) -> str:
    u, v = (_UNIT.format(k=key, s=axis + x) for x in "uv")
    return f"sqrt(-2.0::DOUBLE * ln({u})) * cos(2.0::DOUBLE * 3.141592653589793::DOUBLE * {v})"


_AT, _LIMB = "(key || '/' || p.frame || '/' || p.joint)", "(key || '/limb/' || p.joint)"
_MOVED = ", ".join(
    f"round(CASE WHEN {_UNIT.format(k=_AT, s='drop')} < rate THEN 0.0::DOUBLE ELSE p.{a} + {_normal_sql(_AT, a)} * sigma END"
    f" + CASE WHEN p.joint IN (7,8,9,10,13,14,15,16) THEN {_normal_sql(_LIMB, a)} * sigma * 0.75::DOUBLE ELSE 0.0::DOUBLE END, 6) {a}"
    for a in "xyz"
)
MOVED_SQL = f"""
sg AS (SELECT *, 0.02::DOUBLE + 0.06::DOUBLE * {_UNIT.format(k='key', s='sigma')} sigma FROM dr),
mv AS (SELECT d.clip_id, CAST(g AS INT) frame, p.joint, {_MOVED}, CASE WHEN {_UNIT.format(k=_AT, s='drop')} < rate THEN 0.0::DOUBLE ELSE p.conf END conf
  FROM sg d, (SELECT unnest(range(0, 10)) g) q, pose p WHERE g <= last AND p.clip_id = d.clip_id AND p.frame = greatest(0, least(last, g - sh)))"""


@query(
    "c07_augment_clips",
    ctes=(POSE_SQL, AUGMENT_SQL, MOVED_SQL),
    sql="SELECT clip_id, frame, joint, x, y, z, conf FROM mv",
)
def c07(spark, sf_dir):
    moved = S.augment_clips(pose_frames(spark, sf_dir).select("clip_id", "frame", "p", "c"), 2718)
    return moved.select("clip_id", "frame", "joint", *R6("x", "y", "z"), "conf")


@query("c07_augment_visibility", ctes=(POSE_SQL, AUGMENT_SQL), sql="SELECT clip_id, frame, joint, conf FROM au")
def c07_visible(spark, sf_dir):
    return c07(spark, sf_dir).select("clip_id", "frame", "joint", "conf")


# --- sets and scalars ---------------------------------------------------------------


@query("u01_bank_union", ctes=(GRADED_SQL,), sql="SELECT clip_id, CASE WHEN split='training' THEN 'correction' ELSE 'unseen' END source FROM graded WHERE label='experts'")
def u01(spark, sf_dir):
    rows = graded(spark, sf_dir).where("label = 'experts'")
    a = rows.where("split = 'training'").withColumn("source", F.lit("correction"))
    return a.unionByName(rows.where("split <> 'training'").withColumn("source", F.lit("unseen"))).select("clip_id", "source")


@query("u02_distinct_keyframes", ctes=("d AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) ks FROM lineitem GROUP BY 1)",), sql="SELECT l_orderkey, ks FROM d")
def u02(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ks"))


@query("u03_concat_cohorts", ctes=(GRADED_SQL,), sql="SELECT filename, label, total_grade > 50 AS good FROM graded")
def u03(spark, sf_dir):
    from motionlake.sources.tables import concat_scores

    rows = graded(spark, sf_dir)
    both = concat_scores(rows.where("label = 'beginners'").drop("label"), rows.where("label = 'experts'").drop("label"))
    return both.select("filename", "label", (F.col("total_grade") > 50).alias("good"))


@query(
    "u04_subset_test",
    ctes=("s AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) js FROM lineitem GROUP BY 1)",),
    sql="SELECT l_orderkey, len([1 FOR j IN js IF NOT list_contains([1,2,3,4], j)]) = 0 inside FROM s",
)
def u04(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("js"))
    return sets.select("l_orderkey", (F.size(F.array_except("js", F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))) == 0).alias("inside"))


@query("u05_required_rows", ctes=(GRADED_SQL,), sql="SELECT DISTINCT clip_id FROM (SELECT clip_id FROM graded WHERE split='test' UNION ALL SELECT clip_id FROM graded WHERE label='experts')")
def u05(spark, sf_dir):
    rows = graded(spark, sf_dir)
    return rows.where("split = 'test'").select("clip_id").union(rows.where("label = 'experts'").select("clip_id")).dropDuplicates()


@query(
    "u06_allowed_frames",
    ctes=("s AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) js FROM lineitem GROUP BY 1)",),
    sql="SELECT l_orderkey, list_sort([j FOR j IN js IF list_contains([2,4,6], j)]) allowed FROM s",
)
def u06(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("js"))
    return sets.select("l_orderkey", F.array_sort(F.array_intersect("js", F.array(*[F.lit(i) for i in (2, 4, 6)]))).alias("allowed"))


@query(
    "x08_correction_direction",
    ctes=(POSE_SQL,),
    sql="""SELECT clip_id, frame, joint, CASE WHEN sqrt((x/4)**2+(y/4)**2+(z/4)**2) < 0.01 THEN 'minimal_change' WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x > 0 THEN 'toward_dominant_side' ELSE 'toward_non_dominant_side' END
WHEN abs(y) >= abs(z) THEN CASE WHEN y > 0 THEN 'raise' ELSE 'lower' END ELSE CASE WHEN z > 0 THEN 'forward' ELSE 'backward' END END direction FROM pose""",
)
def x08(spark, sf_dir):
    from motionlake.catalog.views import pose_joints

    return pose_joints(spark, sf_dir).select("clip_id", "frame", "joint", C.direction(F.col("x") / 4, F.col("y") / 4, F.col("z") / 4).alias("direction"))


@query("x14_half_even", ctes=("v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 4.0::DOUBLE q FROM lineitem)",), sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(q, 0) r FROM v")
def x14(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.half_even(F.col("l_quantity") / 4.0).alias("r"))


@query("x15_finite_minimum", ctes=(GRADED_SQL,), sql="SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN NULL ELSE least(correction_distance, 0.3::DOUBLE) END m FROM graded")
def x15(spark, sf_dir):
    v = C.finite(F.when(F.col("clip_id") % 3 == 0, float("nan")).otherwise(F.col("correction_distance")))
    return graded(spark, sf_dir).select("clip_id", F.when(v.isNotNull(), F.least(v, F.lit(0.3))).alias("m"))


@query(
    "x16_file_names",
    sql="""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) file_name, lower(CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '.\\.[^.]+$') THEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]+)$', 1) ELSE '' END) suffix FROM pages""",
)
def x16(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.file_name(url).alias("file_name"), C.file_suffix(url).alias("suffix"))


@query("x17_timestamps", ctes=("f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 30.0::DOUBLE ELSE 25.0::DOUBLE END fps FROM lineitem)",), sql='SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_partkey / fps, 6) AS "seconds" FROM f')
def x17(spark, sf_dir):
    fps = F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(25.0)
    rate = F.when(fps > 0, fps).otherwise(30.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_partkey") / rate, 6).alias("seconds"))


@query("x20_hand_note", ctes=(GRADED_SQL,), sql=f"SELECT clip_id, CASE WHEN clip_id % 10 = 0 THEN '{spec.HAND_NOTE_UNKNOWN}' WHEN handedness = 'left' THEN '{spec.HAND_NOTE['left']}' ELSE '{spec.HAND_NOTE['right']}' END note FROM graded")
def x20(spark, sf_dir):
    hand = F.when(F.col("clip_id") % 10 == 0, None).otherwise(F.upper("handedness"))
    return graded(spark, sf_dir).select("clip_id", C.hand_note(hand).alias("note"))
