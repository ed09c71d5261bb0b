"""Annotation store rows, feedback validation and coaching context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.columns import annotation_state, hand_note
from motionlake.operators.timewarp import ordered_inside, phase_of_frame

KEY = "sample_id"


def clean_annotation(rows: DataFrame) -> DataFrame:
    """Defaults of a saved annotation: text '' and usable 'yes' unless exactly 'no'."""
    text = [c for c in ("feedback", "correction", "annotator", "notes") if c in rows.columns]
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in text})
    if "usable" in rows.columns:
        out = out.withColumn("usable", F.when(F.col("usable") == "no", "no").otherwise("yes"))
    return out


def latest_annotations(writes: DataFrame, order: Sequence[str], key: str = KEY) -> DataFrame:
    """Last write per key wins (partial aggregate, no sort of a key's history)."""
    rest = [c for c in writes.columns if c not in (key, *order)]
    best = writes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_w"))
    return best.select(key, *[F.col(f"_w.{c}").alias(c) for c in (*order, *rest)])


def with_state(samples: DataFrame, annotations: DataFrame, key: str = KEY) -> DataFrame:
    """Samples with the state of their latest annotation (at most one row per key)."""
    saved = annotations.select(
        key,
        F.lit(True).alias("_exists"),
        F.col("score").alias("_score"),
        F.col("feedback").alias("_feedback"),
        F.col("correction").alias("_correction"),
    )
    state = annotation_state(
        F.coalesce("_exists", F.lit(False)), F.col("_score"), F.col("_feedback"), F.col("_correction")
    )
    return samples.join(saved, key, "left").withColumn("state", state).drop(
        "_exists", "_score", "_feedback", "_correction"
    )


def annotation_by_id(ids: DataFrame, annotations: DataFrame, key: str = KEY) -> DataFrame:
    """Requested ids with an ``exists`` flag and the stored document."""
    document = F.struct(*[c for c in annotations.columns if c != key])
    stored = annotations.select(key, document.alias("document"))
    return ids.join(stored, key, "left").withColumn("exists", F.col("document").isNotNull())


def status_lookup(ids: DataFrame, annotations: DataFrame, key: str = KEY) -> DataFrame:
    """State of each distinct requested id."""
    return with_state(ids.select(key).distinct(), annotations, key)


def facet_filter(samples: DataFrame, filters: Mapping[str, str | None]) -> DataFrame:
    """AND of the given facets; an empty value means no filter."""
    for column, value in filters.items():
        if value:
            samples = samples.where(F.col(column) == value)
    return samples


def facets(samples: DataFrame, columns: Sequence[str] = ("skill", "key_frame", "cohort", "source")) -> DataFrame:
    """Distinct values of each facet with their counts, in long form."""
    return samples.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    ).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def annotation_progress(
    samples: DataFrame, annotations: DataFrame, by: Sequence[str] = ("skill", "key_frame", "cohort"), key: str = KEY
) -> DataFrame:
    """Samples per facet combination and annotation state."""
    return with_state(samples, annotations, key).groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))


# --- feedback -----------------------------------------------------------------------


def has_chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


TEXT_LIMITS = {"feedback": (10, 180), "evidence": (10, 240), "overall_feedback": (10, 320)}


def text_violations(problems: DataFrame, fields: Sequence[str] = ("feedback", "evidence")) -> Column:
    """Array of violated text rules of a problem row."""
    checks = []
    for f in fields:
        low, high = TEXT_LIMITS[f]
        value = F.coalesce(F.col(f), F.lit(""))
        checks.append(F.when(~F.length(value).between(low, high), f"{f} length"))
        checks.append(F.when(~has_chinese(value), f"{f} language"))
    if "joint_ids" in problems.columns:
        joints = F.col("joint_ids")
        checks.append(F.when(~F.coalesce(F.size(joints).between(1, 6), F.lit(False)), "joint count"))
        checks.append(F.when(F.exists(joints, lambda j: ~j.between(0, spec.JOINTS - 1)), "joint id"))
    if "confidence" in problems.columns:
        checks.append(F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence range"))
    if "frame_index" in problems.columns:
        checks.append(F.when(~F.coalesce(F.col("frame_index").between(0, spec.CLIP_FRAMES - 1), F.lit(False)), "frame range"))
    return F.array_compact(F.array(*checks))


def allowed_frames(rules: Column, anchors: Column) -> Column:
    """Anchor frames a rule may be judged on."""
    return F.transform(rules, lambda i: F.get(anchors, i))


def feedback_violations(problems: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Broken contract rules per problem, one row each; valid problems give none.

    ``problems`` name a rule of their skill; ``clips`` bring skill, anchors and the
    key frames that were shown.
    """
    rules = F.broadcast(spec.rules(problems.sparkSession).select(
        F.col("skill").alias("_rule_skill"), "rule_id",
        F.col("name").alias("_name"), F.col("phase").alias("_phase"),
        "measured_joints", "anchor_positions",
    ))
    joined = problems.join(clips.select(key, F.col("skill").alias("_clip_skill"), "anchors", "keyframes"), key)
    joined = joined.join(
        rules, (F.col("skill") == F.col("_rule_skill")) & (problems["rule_id"] == rules["rule_id"]), "left"
    ).drop(rules["rule_id"])
    known = F.col("_name").isNotNull()
    outside = F.size(F.array_except("joint_ids", "measured_joints")) > 0
    shown = F.array_contains("keyframes", F.col("frame_index"))
    allowed = F.array_contains(allowed_frames(F.col("anchor_positions"), F.col("anchors")), F.col("frame_index"))
    at = phase_of_frame(F.col("frame_index"), F.col("anchors"), F.col("skill"))
    checks = F.array_compact(F.array(
        F.when(F.col("skill") != F.col("_clip_skill"), "skill"),
        F.when(~known, "unknown rule"),
        F.when(known & (F.col("title") != F.col("_name")), "title"),
        F.when(known & (F.col("phase") != F.col("_phase")), "phase"),
        F.when(known & outside, "joints"),
        F.when(~shown, "frame not supplied"),
        F.when(shown & (F.col("phase") != at), "frame phase"),
        F.when(known & ~allowed, "frame not allowed"),
    ))
    return joined.select(key, "problem", F.explode(checks).alias("violation"))


def attach_rule_scores(problems: DataFrame, clips: DataFrame, criteria: DataFrame, key: str = "clip_id") -> DataFrame:
    """Title, phase, joints and score of the rule; the frame snaps to its nearest anchor.

    The first allowed anchor wins ties. At most five anchors are looked at per problem.
    """
    rules = spec.rules(problems.sparkSession).select(
        "skill", "rule_id", F.col("name").alias("title"), "phase",
        F.col("coaching_joints").alias("joint_ids"), "anchor_positions",
    )
    rows = problems.select(key, "problem", "skill", "rule_id", "frame_index").join(
        F.broadcast(rules), ["skill", "rule_id"]
    ).join(clips.select(key, "anchors"), key)
    frames = allowed_frames(F.col("anchor_positions"), F.col("anchors"))
    ranked = F.transform(frames, lambda f, i: F.struct(F.abs(f - F.col("frame_index")).alias("d"), i.alias("i"), f.alias("f")))
    snapped = F.array_min(ranked)["f"]
    scores = criteria.select(key, "rule_id", F.col("grade").alias("criterion_score"), F.col("maximum").alias("criterion_maximum"))
    return rows.withColumn("frame_index", snapped).join(scores, [key, "rule_id"], "left").drop("anchor_positions", "anchors")


def feedback_rows(problems: DataFrame) -> DataFrame:
    """Flat export rows: joint ids joined with a pipe."""
    return problems.withColumn("joint_ids", F.array_join(F.col("joint_ids").cast("array<string>"), "|"))


def parse_feedback(files: DataFrame, text: str = "value", key: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Problems of feedback documents and an error table for unusable documents."""
    problem = (
        "struct<priority:string,title:string,feedback:string,evidence:string,frame_index:int,"
        "phase:string,joint_ids:array<int>,rule_reference:string,confidence:double>"
    )
    schema = f"struct<skill:string,correction_total_score:double,analysis:struct<problems:array<{problem}>>>"
    parsed = files.select(key, F.from_json(text, schema).alias("d"))
    problems = F.col("d.analysis.problems")
    score = F.col("d.correction_total_score")
    bad_frame = F.exists(problems, lambda p: ~F.coalesce(p["frame_index"].between(0, spec.CLIP_FRAMES - 1), F.lit(False)))
    bad_joints = F.exists(
        problems,
        lambda p: (F.coalesce(F.size(p["joint_ids"]), F.lit(0)) < 1)
        | F.coalesce(F.exists(p["joint_ids"], lambda j: ~j.between(0, spec.JOINTS - 1)), F.lit(False)),
    )
    error = (
        F.when(F.coalesce(F.size(problems), F.lit(-1)) < 1, "no analysis problems")
        .when(bad_frame, "invalid feedback frame index")
        .when(bad_joints, "invalid feedback joint ids")
        .when(score.isNotNull() & (F.isnan(score) | ~score.between(0.0, 100.0)), "invalid feedback correction score")
    )
    checked = parsed.withColumn("error", error)
    good = checked.where(F.col("error").isNull()).select(
        key, score.alias("correction_total_score"), F.posexplode(problems).alias("problem", "_p")
    )
    return good.select(key, "correction_total_score", "problem", "_p.*"), checked.where(
        F.col("error").isNotNull()
    ).select(key, "error")


def comparison_frames(rules: DataFrame) -> DataFrame:
    """Allowed and comparison frames per rule; the weight transfer compares first and last."""
    allowed = allowed_frames(F.col("anchor_positions"), F.col("anchors"))
    ends = F.array(F.get("anchors", 0), F.get("anchors", 4))
    both = (F.col("skill") == "serve") & (F.col("rule_id") == "weight_transfer")
    return rules.withColumns(
        {"allowed_frames": allowed, "comparison_frames": F.when(both, ends).otherwise(allowed)}
    )


def coaching_context(
    clips: DataFrame, criteria: DataFrame, evidence: DataFrame, plan: DataFrame, key: str = "clip_id"
) -> DataFrame:
    """One JSON document per clip: student, criteria, frames and supporting evidence.

    Every collected list is bounded: 6 criteria, 11 key frames, 13 joints.
    """
    spark = clips.sparkSession
    good = clips.where(ordered_inside(F.col("anchors")))
    rules = comparison_frames(
        good.select(key, "skill", "anchors").join(F.broadcast(spec.rules(spark)), "skill")
    ).join(criteria.select(key, "rule_id", "grade", "distance"), [key, "rule_id"], "left")
    sorted_list = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    per_rule = rules.groupBy(key).agg(
        sorted_list("k", "rule_id", "name", "phase", "maximum", "grade", "distance", "measured_joints",
                    "coaching_joints", "allowed_frames", "comparison_frames").alias("criteria"))
    frames = plan.groupBy(key).agg(
        sorted_list("frame", "source_frame", "timestamp_seconds", "phase", "role").alias("available_frames"))
    joints = evidence.groupBy(key).agg(
        sorted_list(
            F.coalesce("score", F.lit(100.0)).alias("score"), "joint", "keypoint", "worst_phase", "correction_direction"
        ).alias("_j"),
        F.array_sort(
            F.collect_list(F.struct("score", (-F.col("importance_weight")).alias("_w"), "joint", "keypoint"))
        ).alias("_p"),
    )
    student = F.struct(*[c for c in ("filename", "handedness", "total_grade") if c in clips.columns])
    joined = good.join(per_rule, key).join(frames, key, "left").join(joints, key, "left")
    document = F.to_json(F.struct(
        "skill", student.alias("student"), hand_note(F.col("handedness")).alias("handedness_note"),
        "criteria", "available_frames",
        F.transform(F.slice("_p", 1, 5), lambda p: p["keypoint"]).alias("priority_corrections"),
        F.slice("_j", 1, 8).alias("lowest_keypoint_scores"),
    ))
    return joined.select(key, document.alias("context"))


def advice_document(evidence: DataFrame, clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Advice row per clip: all named joints and the five to correct first."""
    per_clip = evidence.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("joint").alias("o"), F.struct(
                "joint", "keypoint", "score", "correction_distance", "importance_weight", "worst_phase",
                "correction_direction", F.array("vx", "vy", "vz").alias("correction_vector")).alias("v")))),
            lambda e: e["v"],
        ).alias("keypoints"),
    )
    first = F.slice(
        F.array_sort(F.transform("keypoints", lambda k: F.struct(
            k["score"].alias("s"), (-k["importance_weight"]).alias("w"), k["joint"].alias("j"), k["keypoint"].alias("n")))), 1, 5)
    named = per_clip.withColumn("priority_corrections", F.transform(first, lambda p: p["n"]))
    return clips.join(named, key).select(key, F.to_json(F.struct(
        *[c for c in ("filename", "label", "handedness", "total_grade") if c in clips.columns],
        "priority_corrections", "keypoints")).alias("document"))


def find_advice(lines: DataFrame, requests: DataFrame, order: str = "line") -> DataFrame:
    """First advice line per requested filename; a missing one is an error row."""
    first = lines.groupBy("filename").agg(F.min(F.struct(order, "document")).alias("_l"))
    return requests.join(first, "filename", "left").select(
        *requests.columns,
        F.col("_l.document").alias("document"),
        F.when(F.col("_l").isNull(), "no advice context found").otherwise("").alias("error"),
    )
