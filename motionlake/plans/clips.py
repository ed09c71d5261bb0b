"""From raw observations to stored clips: the extraction job without the vision part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.timeblocks import join_per_key, rows_in_interval
from motionlake.operators import pose as P
from motionlake.operators import timewarp as W
from motionlake.operators import tracks as T
from motionlake.session import settle

KEY = "clip_id"


def prepare_clips(
    obs3: DataFrame,
    obs2: DataFrame,
    clips: DataFrame,
    strict_hand: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(64-frame normalised clips, one summary row per clip incl. failures).

    ``obs3``/``obs2`` are sparse joints of retained frames (dense frame numbers, with
    ``source_frame``); ``clips`` has clip_id, skill, label, filename, fps and optional
    known_handedness and override_handedness. A failing clip keeps its error and takes
    no part in later steps. Hands, tracks, windows and usable joints are each read by
    several later steps, so they are written to the checkpoint folder once.
    """
    joints3 = P.dense_joints(obs3.select(KEY, "frame", "joint", "x", "y", "z"))
    joints2 = settle(P.dense_joints(obs2.select(KEY, "frame", "joint", "x", "y"), dims=2))
    sizes = obs2.groupBy(KEY).agg((F.max("frame") + 1).alias("n"))
    estimate = P.estimate_handedness(joints2).withColumnRenamed("handedness", "estimate")
    base = clips.join(sizes, KEY, "left").fillna(0, ["n"]).join(estimate, KEY, "left")
    optional = lambda c: F.col(c) if c in clips.columns else F.lit(None).cast("string")
    known, override = optional("known_handedness"), optional("override_handedness")
    if strict_hand:
        hand, hand_error = P.strict_handedness(F.coalesce(known, override, F.lit("auto")), F.col("estimate"))
        source = F.when(hand_error == "", "resolved")
    else:
        hand, source = P.resolve_handedness(known, override, F.col("estimate"), F.col("filename"))
        hand_error = F.lit("")
    meta = settle(
        base.withColumns({"handedness": hand, "handedness_source": source, "_hand_error": hand_error})
    )
    sided = joints2.where(F.col("joint").isin(7, 8, 9, 10))
    side = meta.select(KEY, "handedness", "skill", F.greatest(F.col("n") - 1, F.lit(0)).alias("_last"))
    sided = join_per_key(sided, side, [KEY], "_last")
    wrist = settle(P.dominant_track(sided, "handedness", "wrist")).withColumnRenamed(KEY, "track_id")
    elbow = settle(P.dominant_track(sided, "handedness", "elbow")).withColumnRenamed(KEY, "track_id")
    found = T.analysis_window(wrist, elbow).withColumnRenamed("track_id", KEY).drop("skill")
    # Clamping fills in missing windows, so what was not found is marked before.
    both = elbow.select(F.col("track_id").alias(KEY)).distinct().withColumn("_elbow", F.lit(True))
    windows = meta.join(found, KEY, "left").join(both, KEY, "left")
    lost = F.col("start").isNull() | F.col("end").isNull() | F.col("_elbow").isNull()
    windows = W.clamp_window(windows.withColumn("_lost", lost).drop("_elbow"), "n").withColumnRenamed("error", "_window_error")
    windows = windows.withColumns({c: F.when(~F.col("_lost") & (F.col("n") > 0), F.col(c)) for c in ("start", "peak", "end")})
    windows = windows.withColumn(
        "error",
        F.when(F.col("_hand_error") != "", F.col("_hand_error"))
        .when(F.col("n") < 5, "fewer than five tracked frames")
        .when(F.col("_lost"), "dominant wrist or elbow tracking is insufficient")
        .otherwise(F.col("_window_error")),
    ).drop("_hand_error", "_window_error", "_lost")
    windows = settle(windows)
    bounds = windows.where("error = ''").select(
        KEY, "handedness", "skill", "label", F.col("start").alias("_low"), F.col("end").alias("_high"), "peak"
    )
    merged = P.merge_confidence(joints3, joints2)
    inside = settle(
        rows_in_interval(merged, bounds, [KEY], "_low", "_high").withColumn(
            "frame", F.col("frame") - F.col("_low")
        )
    )
    ratio = P.missing_joint_ratio(inside)
    torso = P.missing_torso(inside)
    anchors = bounds.select(KEY, W.phase_anchors(F.col("_low"), F.col("peak"), F.col("_high")).alias("anchors"))
    unordered = W.anchor_errors(anchors)
    status = (
        windows.join(ratio, KEY, "left")
        .join(torso, KEY, "left")
        .join(unordered.withColumnRenamed("error", "_order"), KEY, "left")
        .withColumn(
            "error",
            F.when(F.col("error") != "", F.col("error"))
            .when(F.col("missing_joint").isNotNull(), F.concat(F.lit("critical torso joint "), F.col("missing_joint").cast("string"), F.lit(" is missing for the full window")))
            .when(F.col("_order").isNotNull(), F.col("_order"))
            .otherwise(""),
        )
        .withColumn("status", F.when(F.col("error") == "", "success").otherwise("error"))
    )
    good = status.where("status = 'success'").select(KEY, (F.col("end") - F.col("start")).alias("_last"))
    usable = join_per_key(inside, good, [KEY], "_last").select(KEY, "frame", "joint", "x", "y", "z", "conf", "handedness", "skill", "label")
    normal = settle(P.normalize_pose(usable, keep=("skill", "label")))
    sequence = W.resample(normal.select(KEY, "frame", "p", "c", "handedness", "skill", "label")).join(anchors, KEY)
    summary = status.select(
        KEY, "filename", "label", "skill", "handedness", "handedness_source",
        F.coalesce("left_motion_score", F.lit(0.0)).alias("left_hand_motion_score"),
        F.coalesce("right_motion_score", F.lit(0.0)).alias("right_hand_motion_score"),
        F.coalesce("confidence_ratio", F.lit(1.0)).alias("handedness_confidence_ratio"),
        F.col("n").cast("int").alias("raw_tracked_frames"),
        F.coalesce("start", F.lit(-1)).alias("analysis_start"),
        F.coalesce("peak", F.lit(-1)).alias("analysis_peak"),
        F.coalesce("end", F.lit(-1)).alias("analysis_end"),
        F.when(F.col("status") == "success", spec.CLIP_FRAMES).otherwise(0).alias("resampled_frames"),
        F.coalesce("missing_joint_ratio", F.lit(1.0)).alias("missing_joint_ratio"),
        "status", "error",
    )
    return sequence, summary


def source_frame_map(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Source frame of each of the 64 clip frames, and at the anchors.

    ``frames`` has (clip_id, frame, source_frame); ``windows`` start, end and anchors.
    """
    bounds = windows.select(KEY, F.col("start").alias("_low"), F.col("end").alias("_high"))
    inside = rows_in_interval(frames, bounds, [KEY], "_low", "_high").select(
        KEY, (F.col("frame") - F.col("_low")).alias("frame"), F.col("source_frame").cast("double").alias("_at")
    )
    mapped = W.resample(inside, values=("_at",)).withColumn("_at", F.rint("_at").cast("int"))
    # exactly 64 rows per clip
    lists = mapped.groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "_at"))), lambda r: r["_at"]).alias("source_frame_indices")
    )
    return windows.join(lists, KEY).withColumn(
        "source_phase_indices", F.transform("anchors", lambda a: F.get("source_frame_indices", a))
    )
