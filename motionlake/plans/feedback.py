"""Feedback preparation: coaching context, contract checks and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators import annotations as A
from motionlake.operators import timewarp as W

KEY = "clip_id"


def feedback_dataset(
    clips: DataFrame, criteria: DataFrame, evidence: DataFrame, problems: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(context document per clip, export rows, contract violations).

    ``problems`` are the answers of the external reviewer: clip_id, problem, skill,
    rule_id, frame_index, feedback, evidence, confidence. Rule fields are overwritten
    from the contract before they are checked.
    """
    plan = W.keyframe_plan(clips)
    context = A.coaching_context(clips, criteria, evidence, plan)
    attached = A.attach_rule_scores(problems, clips, criteria)
    texts = problems.select(KEY, "problem", "feedback", "evidence", "confidence")
    complete = attached.join(texts, [KEY, "problem"])
    shown = clips.withColumn("keyframes", W.keyframes(F.col("anchors")))
    broken = A.feedback_violations(complete, shown)
    wording = complete.select(KEY, "problem", F.explode(A.text_violations(complete)).alias("violation"))
    stamps = plan.select(KEY, F.col("frame").alias("frame_index"), "timestamp_seconds")
    bad = broken.unionByName(wording)
    good = complete.join(bad.select(KEY, "problem").distinct(), [KEY, "problem"], "left_anti")
    rows = A.feedback_rows(good.join(stamps, [KEY, "frame_index"], "left"))
    return context, rows, bad
