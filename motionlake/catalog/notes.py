"""Queries over annotations and feedback, and over documents read and written as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionlake import spec
from motionlake.catalog.distances import CAL_SQL, EVIDENCE_SQL, BASE, TERM_SQL, calibration, pairs64
from motionlake.catalog.poses import ANCHOR_SQL, R6, _anchors
from motionlake.catalog.registry import query
from motionlake.catalog.views import ANNOTATION_SQL, GRADED_SQL, UPSERT_SQL, annotations, graded, table, upserts
from motionlake.operators import annotations as A
from motionlake.operators import grading as G
from motionlake.operators import timewarp as W
from motionlake.plans.feedback import feedback_dataset
from motionlake.session import settle

STATE = """CASE WHEN NOT started THEN 'unannotated' WHEN score IS NOT NULL AND (regexp_replace(feedback, '\\s', '', 'g') <> '' OR correction <> '') THEN 'annotated' ELSE 'in_progress' END"""


def _samples(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    samples = rows.select("sample_id", "skill", "key_frame", "cohort", "source")
    saved = rows.where("started").select("sample_id", "score", "feedback", "correction", "usable")
    return samples, saved


@query("j17_sample_status", ctes=(ANNOTATION_SQL,), sql=f"SELECT sample_id, skill, cohort, {STATE} state FROM ann")
def j17(spark, sf_dir):
    samples, saved = _samples(spark, sf_dir)
    return A.with_state(samples, saved).select("sample_id", "skill", "cohort", "state")


@query("x24_annotation_state", ctes=(ANNOTATION_SQL,), sql=f"SELECT state, count(*) n FROM (SELECT {STATE} state FROM ann) GROUP BY 1")
def x24(spark, sf_dir):
    samples, saved = _samples(spark, sf_dir)
    return A.with_state(samples, saved).groupBy("state").agg(F.count("*").alias("n"))


@query("s19_status_lookup", ctes=(ANNOTATION_SQL,), sql=f"SELECT sample_id, {STATE} state FROM ann WHERE sample_id IN (SELECT l_partkey FROM lineitem)")
def s19(spark, sf_dir):
    samples, saved = _samples(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sample_id"))
    known = wanted.join(samples.select("sample_id"), "sample_id", "left_semi")
    return A.status_lookup(known, saved)


@query(
    "s17_annotation_by_id",
    ctes=(ANNOTATION_SQL,),
    sql="SELECT o_orderkey sample_id, a.sample_id IS NOT NULL AS \"exists\", a.usable, a.score FROM orders LEFT JOIN (SELECT * FROM ann WHERE started) a ON a.sample_id = o_orderkey",
)
def s17(spark, sf_dir):
    _, saved = _samples(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return A.annotation_by_id(ids, saved).select("sample_id", "exists", "document.usable", "document.score")


@query(
    "s18_annotation_upsert",
    ctes=(UPSERT_SQL,),
    sql="SELECT sample_id, seq, author, feedback, CASE WHEN author = 'user' THEN 'no' ELSE 'yes' END usable FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC, author DESC, feedback DESC) rn FROM ups) WHERE rn = 1",
)
def s18(spark, sf_dir):
    writes = upserts(spark, sf_dir).withColumn("usable", F.when(F.col("author") == "user", "no").otherwise("maybe"))
    return A.latest_annotations(A.clean_annotation(writes), ["seq"]).select("sample_id", "seq", "author", "feedback", "usable")


@query(
    "s16_sample_manifest",
    ctes=(ANNOTATION_SQL,),
    sql="SELECT CAST(sample_id AS VARCHAR) sample_id, skill, key_frame, cohort, source, sample_id / 2.0::DOUBLE elbow FROM ann",
)
def s16(spark, sf_dir):
    from motionlake.sources.tables import parse_samples

    rows = annotations(spark, sf_dir)
    document = F.to_json(F.struct(
        F.col("sample_id").cast("string").alias("sample_id"),
        F.struct(
            "skill", F.col("key_frame").alias("key_frame_name"), "cohort", F.col("source").alias("source_dataset"),
            F.create_map(F.lit("Left Elbow Angle"), F.col("sample_id") / 2).alias("angles"),
        ).alias("metadata"),
    ))
    lines = rows.select(F.explode(F.array(F.concat(F.lit("  "), document, F.lit(" ")), F.lit("   "))).alias("value"))
    m = F.col("metadata")
    return parse_samples(lines).select(
        "sample_id", m["skill"].alias("skill"), m["key_frame_name"].alias("key_frame"), m["cohort"].alias("cohort"),
        m["source_dataset"].alias("source"), m["angles"]["Left Elbow Angle"].alias("elbow"),
    )


@query("p22_facet_filter", ctes=(ANNOTATION_SQL,), sql=f"SELECT sample_id FROM (SELECT *, {STATE} state FROM ann) WHERE skill = 'clear' AND cohort = 'beginners' AND state = 'annotated'")
def p22(spark, sf_dir):
    samples, saved = _samples(spark, sf_dir)
    chosen = A.facet_filter(samples, {"skill": "clear", "key_frame": "", "cohort": "beginners", "source": None})
    return A.with_state(chosen, saved).where("state = 'annotated'").select("sample_id")


@query(
    "a25_facets",
    ctes=(ANNOTATION_SQL,),
    sql=" UNION ALL ".join(f"SELECT '{c}' facet, {c} AS \"value\", count(*) n FROM ann GROUP BY {c}" for c in ("skill", "key_frame", "cohort", "source")),
)
def a25(spark, sf_dir):
    return A.facets(annotations(spark, sf_dir))


@query("c17_annotation_progress", ctes=(ANNOTATION_SQL,), sql=f"SELECT skill, key_frame, cohort, state, count(*) n FROM (SELECT *, {STATE} state FROM ann) GROUP BY 1, 2, 3, 4")
def c17(spark, sf_dir):
    return A.annotation_progress(*_samples(spark, sf_dir))


TEXT_SQL = """
tx AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '手腕' || text ELSE text END feedback, '手腕發力不足需要再加強一點' evidence, [CAST(i AS INT) FOR i IN range(doc_id % 8)] joint_ids, (doc_id % 13) / 10.0::DOUBLE confidence FROM documents)"""


@query(
    "p21_text_rules",
    ctes=(TEXT_SQL, """
vi AS (SELECT doc_id, 'feedback length' violation FROM tx WHERE length(feedback) NOT BETWEEN 10 AND 180 UNION ALL SELECT doc_id, 'feedback language' FROM tx WHERE NOT regexp_matches(feedback, '[一-鿿]')
 UNION ALL SELECT doc_id, 'joint count' FROM tx WHERE len(joint_ids) NOT BETWEEN 1 AND 6 UNION ALL SELECT doc_id, 'confidence range' FROM tx WHERE confidence > 1)"""),
    sql="SELECT doc_id, violation FROM vi",
)
def p21(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 2 == 0, F.concat(F.lit("手腕"), "text")).otherwise(F.col("text")).alias("feedback"),
        F.lit("手腕發力不足需要再加強一點").alias("evidence"),
        F.when(d % 8 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (d % 8 - 1).cast("int"))).alias("joint_ids"),
        (F.col("doc_id") % 13 / 10.0).alias("confidence"),
    )
    return rows.select("doc_id", F.explode(A.text_violations(rows)).alias("violation"))


RULE_SQL = "ru AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}',{k},'{r[0]}','{r[1]}','{r[2]}',{r[3]}::DOUBLE,{list(r[4])},{list(r[5])},{list(r[6])})"
    for s in spec.SKILLS for k, r in enumerate(spec.RULES[s])
) + ") v(skill, k, rule_id, name, phase, mx, measured, coaching, pos))"

# problems: one per lineitem row, judged on the clip of its order
PROBLEM_SQL = """
cl AS (SELECT clip_id, (['serve','lift','clear','smash'])[CAST(k AS INT) + 1] skill, anchors FROM anch),
nr AS (SELECT skill, count(*) m FROM ru GROUP BY 1),
pb AS (SELECT DISTINCT l_orderkey clip_id, l_linenumber problem FROM lineitem),
pr0 AS (SELECT p.clip_id, p.problem, c.skill, r.rule_id, r.k, CAST((p.clip_id * 5 + p.problem * 11) % 64 AS INT) frame_index, c.anchors, r.name, r.phase, r.mx, r.measured, r.coaching, r.pos
  FROM pb p JOIN cl c USING (clip_id) JOIN nr USING (skill) JOIN ru r ON r.skill = c.skill AND r.k = (p.clip_id + p.problem) % m)"""


def _problems(spark, sf_dir):
    clips = _anchors(spark, sf_dir).withColumn("keyframes", W.keyframes(F.col("anchors")))
    count = F.when(F.col("skill") == "lift", 4).otherwise(6)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("problem")).distinct()
    rules = spec.rules(spark).select("skill", "k", "rule_id")
    problems = rows.join(clips.select("clip_id", "skill"), "clip_id").withColumn(
        "k", ((F.col("clip_id") + F.col("problem")) % count).cast("int")
    ).join(F.broadcast(rules), ["skill", "k"]).withColumn(
        "frame_index", ((F.col("clip_id") * 5 + F.col("problem") * 11) % 64).cast("int")
    )
    return clips, problems


@query(
    "j13_attach_rule_scores",
    ctes=(ANCHOR_SQL, RULE_SQL, PROBLEM_SQL, """
sn AS (SELECT *, unnest(pos) ap, unnest(range(0, len(pos))) ai FROM pr0),
rk AS (SELECT *, anchors[ap + 1] f, row_number() OVER (PARTITION BY clip_id, problem ORDER BY abs(anchors[ap + 1] - frame_index), ai) rn FROM sn)"""),
    sql="SELECT clip_id, problem, skill, rule_id, CAST(f AS INT) frame_index, name title, phase, CAST(coaching AS INT[]) joint_ids, mx / 2 criterion_score, mx criterion_maximum FROM rk WHERE rn = 1",
)
def j13(spark, sf_dir):
    clips, problems = _problems(spark, sf_dir)
    criteria = clips.join(F.broadcast(spec.criteria(spark)), "skill").select("clip_id", "rule_id", (F.col("maximum") / 2).alias("grade"), "maximum")
    out = A.attach_rule_scores(problems, clips, criteria)
    return out.select("clip_id", "problem", "skill", "rule_id", "frame_index", "title", "phase", "joint_ids", "criterion_score", "criterion_maximum")


PHASE_AT = """CASE skill WHEN 'lift' THEN CASE WHEN frame_index < anchors[2] THEN 'preparation' WHEN frame_index < anchors[4] THEN 'backswing' WHEN frame_index <= anchors[4] THEN 'contact' ELSE 'follow_through' END
WHEN 'serve' THEN CASE WHEN frame_index <= anchors[2] THEN 'preparation' WHEN frame_index < anchors[4] THEN 'weight_transfer' WHEN frame_index <= anchors[4] THEN 'contact' ELSE 'follow_through' END
ELSE CASE WHEN frame_index < anchors[2] THEN 'preparation' WHEN frame_index < anchors[3] THEN 'rotation' WHEN frame_index <= anchors[3] THEN 'contact' ELSE 'follow_through' END END"""
VIOLATION_SQL = f"""
vj AS (SELECT *, CASE WHEN problem % 5 = 0 THEN 'other' ELSE name END title, CASE WHEN problem % 4 = 0 THEN 'contact' ELSE phase END said, CASE WHEN problem % 3 = 0 THEN [0, 1] ELSE coaching END joint_ids,
  list_contains([anchors[1], anchors[2], anchors[3], anchors[4], anchors[5], (anchors[1]+anchors[2])//2, (anchors[2]+anchors[3])//2, (anchors[3]+anchors[4])//2, (anchors[4]+anchors[5])//2, greatest(anchors[2], anchors[3]-3), least(anchors[4], anchors[3]+3)], frame_index) shown,
  {PHASE_AT} at_phase, list_contains([anchors[q + 1] FOR q IN pos], frame_index) allowed FROM pr0),
vv AS (SELECT clip_id, problem, 'title' violation FROM vj WHERE title <> name UNION ALL SELECT clip_id, problem, 'phase' FROM vj WHERE said <> phase
 UNION ALL SELECT clip_id, problem, 'joints' FROM vj WHERE len([1 FOR j IN joint_ids IF NOT list_contains(measured, j)]) > 0
 UNION ALL SELECT clip_id, problem, 'frame not supplied' FROM vj WHERE NOT shown UNION ALL SELECT clip_id, problem, 'frame phase' FROM vj WHERE shown AND said <> at_phase
 UNION ALL SELECT clip_id, problem, 'frame not allowed' FROM vj WHERE NOT allowed)"""


@query("p20_feedback_contract", ctes=(ANCHOR_SQL, RULE_SQL, PROBLEM_SQL, VIOLATION_SQL), sql="SELECT clip_id, problem, violation FROM vv")
def p20(spark, sf_dir):
    clips, problems = _problems(spark, sf_dir)
    rules = spec.rules(spark).select("skill", "rule_id", "name", F.col("phase").alias("rule_phase"), "coaching_joints")
    n = F.col("problem")
    said = problems.join(F.broadcast(rules), ["skill", "rule_id"]).select(
        "clip_id", "problem", "skill", "rule_id", "frame_index",
        F.when(n % 5 == 0, "other").otherwise(F.col("name")).alias("title"),
        F.when(n % 4 == 0, "contact").otherwise(F.col("rule_phase")).alias("phase"),
        F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.col("coaching_joints")).alias("joint_ids"),
    )
    return A.feedback_violations(said, clips)


@query(
    "x21_comparison_frames",
    ctes=(ANCHOR_SQL, RULE_SQL, "cl AS (SELECT clip_id, (['serve','lift','clear','smash'])[CAST(k AS INT) + 1] skill, anchors FROM anch)"),
    sql="SELECT clip_id, rule_id, [anchors[q + 1] FOR q IN pos] allowed_frames, CASE WHEN skill = 'serve' AND rule_id = 'weight_transfer' THEN [anchors[1], anchors[5]] ELSE [anchors[q + 1] FOR q IN pos] END comparison_frames FROM cl JOIN ru USING (skill)",
)
def x21(spark, sf_dir):
    rows = _anchors(spark, sf_dir).join(F.broadcast(spec.rules(spark)), "skill")
    return A.comparison_frames(rows).select("clip_id", "rule_id", "allowed_frames", "comparison_frames")


@query(
    "s22_feedback_rows",
    ctes=(ANCHOR_SQL, RULE_SQL, PROBLEM_SQL),
    sql="SELECT clip_id, problem, rule_id, array_to_string(coaching, '|') joint_ids FROM pr0",
)
def s22(spark, sf_dir):
    clips, problems = _problems(spark, sf_dir)
    none = clips.select("clip_id", F.lit("").alias("rule_id"), F.lit(0.0).alias("grade"), F.lit(0.0).alias("maximum"))
    return A.feedback_rows(A.attach_rule_scores(problems, clips, none)).select("clip_id", "problem", "rule_id", "joint_ids")


@query(
    "x18_delimited_list",
    ctes=("d AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) ks FROM lineitem GROUP BY 1)",),
    sql="SELECT l_orderkey, array_to_string(ks, '|') joint_ids FROM d",
)
def x18(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("joint_ids"))
    return A.feedback_rows(sets)


def _documents(spark, sf_dir):
    """Advice lines in file order, several per file name."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.concat(F.lit("f"), (F.col("doc_id") % 700).cast("string")).alias("filename"),
        F.col("doc_id").alias("line"),
        F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "text")).alias("document"),
    )


@query(
    "s13_advice_lookup",
    ctes=("r AS (SELECT 'f' || o_orderkey filename FROM orders)", "d AS (SELECT 'f' || (doc_id % 700) filename, min(doc_id) id FROM documents GROUP BY 1)"),
    sql="SELECT r.filename, id, CASE WHEN id IS NULL THEN 'no advice context found' ELSE '' END error FROM r LEFT JOIN d USING (filename)",
)
def s13(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"))
    found = A.find_advice(_documents(spark, sf_dir), requests)
    return found.select("filename", F.get_json_object("document", "$.id").cast("bigint").alias("id"), "error")


@query("x19_json_round_trip", sql="SELECT doc_id, lang, text FROM documents")
def x19(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    text = rows.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("j"))
    return text.select(F.from_json("j", "doc_id bigint, lang string, text string").alias("d")).select("d.*")


@query(
    "s05_handedness_overrides",
    sql="SELECT 'c' || doc_id || '.mp4' filename, CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END handedness, CASE WHEN doc_id % 3 = 2 THEN 'handedness must be left or right' ELSE '' END error FROM documents",
)
def s05(spark, sf_dir):
    from motionlake.sources.tables import handedness_overrides

    d = F.col("doc_id")
    value = F.when(d % 3 == 0, "LEFT").when(d % 3 == 1, "right").otherwise("both")
    name = F.concat(F.lit("c"), d.cast("string"), F.lit(".mp4"))
    rows = table(spark, sf_dir, "documents").select(F.to_json(F.create_map(name, value)).alias("value"))
    return handedness_overrides(rows)


@query(
    "s21_feedback_files",
    sql="""SELECT 'f' || doc_id filename, CASE WHEN doc_id % 5 = 0 THEN 'no analysis problems' WHEN doc_id % 70 > 63 THEN 'invalid feedback frame index' WHEN doc_id % 3 = 0 THEN 'invalid feedback joint ids' WHEN doc_id % 120 > 100 THEN 'invalid feedback correction score' ELSE '' END result FROM documents""",
)
def s21(spark, sf_dir):
    d = F.col("doc_id")
    problem = F.struct(
        F.col("text").alias("feedback"), (d % 70).cast("int").alias("frame_index"),
        F.when(d % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((d % 17).cast("int"))).alias("joint_ids"),
    )
    problems = F.when(d % 5 == 0, F.array_remove(F.array(problem), problem)).otherwise(F.array(problem))
    document = F.to_json(F.struct(F.lit("clear").alias("skill"), (d % 120).cast("double").alias("correction_total_score"), F.struct(problems.alias("problems")).alias("analysis")))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), d.cast("string")).alias("filename"), document.alias("value"))
    good, bad = A.parse_feedback(files)
    return good.select("filename", F.lit("").alias("result")).unionByName(bad.withColumnRenamed("error", "result"))


@query("s20_old_scores", ctes=(GRADED_SQL,), sql="SELECT label, count(*) n, round(avg(total_grade),6) mean FROM graded GROUP BY 1")
def s20(spark, sf_dir):
    from motionlake.sources.tables import concat_scores

    rows = graded(spark, sf_dir)
    both = concat_scores(rows.where("label = 'beginners'"), rows.where("label = 'experts'"))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("total_grade"), 6).alias("mean"))


@query(
    "s15_ragged_union",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, CASE WHEN label='experts' THEN handedness END handedness, skill, CASE WHEN label='beginners' THEN split END AS split FROM graded",
)
def s15(spark, sf_dir):
    from motionlake.sources.tables import ragged_union

    rows = graded(spark, sf_dir)
    return ragged_union([
        rows.where("label = 'experts'").select("clip_id", "skill", "handedness"),
        rows.where("label = 'beginners'").select("split", "skill", "clip_id"),
    ])


# --- documents per clip ---------------------------------------------------------------


def _clips(spark, sf_dir):
    """Clips with anchors, hand and grade, their criteria and evidence.

    The pairs feed several aggregations, so they are written out once.
    """
    pairs = settle(pairs64(spark, sf_dir))
    totals, criteria = G.grade_clips(pairs, calibration(spark))
    anchors = F.expr("array(clip_id % 3, 12 + clip_id % 9, 30 + clip_id % 7, 45 + clip_id % 8, 62 + clip_id % 2)")
    clips = totals.select(
        "clip_id", "skill", "total_grade",
        F.concat(F.lit("clip_"), F.col("clip_id").cast("string")).alias("filename"),
        F.when(F.floor(F.col("clip_id") / 1000) % 5 == 0, "left").otherwise("right").alias("handedness"),
        anchors.alias("anchors"), F.lit(25.0).alias("fps"), F.sequence(F.lit(0), F.lit(63)).alias("source_frame_indices"),
    )
    return clips, settle(criteria), G.keypoint_evidence(pairs, calibration(spark))


@query(
    "x25_coaching_context",
    ctes=(*BASE, TERM_SQL, CAL_SQL, EVIDENCE_SQL, """
low AS (SELECT clip_id, list(joint ORDER BY score, joint)[1:8] l, list(joint ORDER BY score, importance DESC, joint)[1:5] p FROM ev GROUP BY 1)"""),
    sql="SELECT clip_id, l[1] lowest_joint, len(l) n_lowest, len(p) n_priority FROM low",
)
def x25(spark, sf_dir):
    clips, criteria, joints = _clips(spark, sf_dir)
    context = A.coaching_context(clips, criteria, joints, W.keyframe_plan(clips))
    low = F.from_json(F.get_json_object("context", "$.lowest_keypoint_scores"), "array<struct<joint:int>>")
    first = F.from_json(F.get_json_object("context", "$.priority_corrections"), "array<string>")
    return context.select("clip_id", low[0]["joint"].alias("lowest_joint"), F.size(low).cast("bigint").alias("n_lowest"), F.size(first).cast("bigint").alias("n_priority"))


@query(
    "s10_advice_documents",
    ctes=(*BASE, TERM_SQL, CAL_SQL, EVIDENCE_SQL),
    sql="SELECT clip_id, count(*) keypoints, round(min(score),6) lowest FROM ev GROUP BY 1",
)
def s10(spark, sf_dir):
    clips, _, joints = _clips(spark, sf_dir)
    rows = A.advice_document(joints, clips)
    kp = F.from_json(F.get_json_object("document", "$.keypoints"), "array<struct<score:double>>")
    return rows.select("clip_id", F.size(kp).cast("bigint").alias("keypoints"), F.round(F.array_min(F.transform(kp, lambda k: k["score"])), 6).alias("lowest"))


@query("c16_feedback_dataset")
def c16(spark, sf_dir):
    clips, criteria, joints = _clips(spark, sf_dir)
    rules = spec.rules(spark).where("k < 3").select("skill", "k", "rule_id")
    problems = clips.select("clip_id", "skill").join(F.broadcast(rules), "skill").select(
        "clip_id", F.col("k").alias("problem"), "skill", "rule_id", F.lit(30).alias("frame_index"),
        F.lit("擊球瞬間手腕發力不足，請加強前臂帶動。").alias("feedback"), F.lit("影像顯示手腕在擊球時沒有向前。").alias("evidence"), F.lit(0.8).alias("confidence"),
    )
    _, rows, _ = feedback_dataset(clips, criteria, joints, problems)
    return rows.select("clip_id", "problem", "rule_id", "frame_index", "joint_ids", *R6("criterion_score", "timestamp_seconds"))
