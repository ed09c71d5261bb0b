"""Resampling and phase alignment of clips.

Everything is one operator, :func:`warp`: a frame axis is mapped piecewise linearly so
that the knots S land on the knots T. Each source frame computes, in integer arithmetic,
which target frames fall between it and its successor, so no join with a target grid
is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.timeblocks import block_window, join_per_key, own_rows, with_halo

KEY = "clip_id"


def warp(
    frames: DataFrame,
    source: str,
    target: str,
    length: int,
    values: Sequence[str] = ("p", "c"),
    key: str = KEY,
) -> DataFrame:
    """Linear values at ``length`` target frames; array and double columns alike.

    ``source`` and ``target`` name integer-array columns of equally many increasing
    knots. Targets outside the knots hold the value of the nearest knot.
    """
    w = block_window([key])
    types = dict(frames.dtypes)
    rows = own_rows(
        with_halo(frames, after=1).withColumns({f"_n_{v}": F.lead(v).over(w) for v in values})
    )
    # segment k: the last knot at or before this frame, but never the final knot
    rows = rows.withColumn(
        "_k", F.expr(f"least(size(filter({source}, s -> s <= frame)), size({source}) - 1)")
    ).withColumn("_at_end", F.expr(f"frame = {source}[size({source}) - 1]"))
    knots = f"""
        {source}[_k - 1] AS _s0, {source}[_k] AS _s1, {target}[_k - 1] AS _t0, {target}[_k] AS _t1,
        {target}[size({target}) - 1] AS _t_end"""
    rows = rows.where(F.expr(f"_k >= 1 AND frame <= {source}[size({source}) - 1]")).selectExpr(
        "*", *[k.strip() for k in knots.split(",")]
    )
    # a one-frame clip has equal source knots; it is all "at the end" and never divides
    rows = rows.selectExpr("*", "greatest(_s1 - _s0, 1) AS _ds", "_t1 - _t0 AS _dt")
    # target g belongs to this frame f when f <= s0 + (g - t0) ds / dt < f + 1
    first = "_t0 + ((frame - _s0) * _dt + _ds - 1) div _ds"
    last = "_t0 + ((frame + 1 - _s0) * _dt + _ds - 1) div _ds - 1"
    low = f"CASE WHEN frame = {source}[0] THEN 0 WHEN _at_end THEN _t_end ELSE {first} END"
    high = f"CASE WHEN _at_end THEN {length - 1} ELSE {last} END"
    rows = rows.selectExpr("*", f"{low} AS _low", f"{high} AS _high").where("_low <= _high")
    keep = [c for c in frames.columns if c not in (*values, "frame")]
    rows = rows.withColumn("_g", F.expr("explode(sequence(_low, _high))"))
    inside = "greatest(_g, _t0)"
    step = (
        f"CASE WHEN _at_end THEN 0.0D ELSE "
        f"(({inside} - _t0) * _ds - (frame - _s0) * _dt) / CAST(_dt AS DOUBLE) END"
    )
    rows = rows.withColumn("_w", F.expr(step))

    def lerp(v: str) -> Column:
        if types[v].startswith("array"):
            return F.when(
                F.col("_w") == 0, F.col(v)
            ).otherwise(F.expr(f"zip_with({v}, _n_{v}, (a, b) -> a + (b - a) * _w)")).alias(v)
        return F.when(F.col("_w") == 0, F.col(v)).otherwise(
            F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * F.col("_w")
        ).alias(v)

    return rows.select(*keep, F.col("_g").cast("int").alias("frame"), *[lerp(v) for v in values])


def resample(
    frames: DataFrame, length: int = spec.CLIP_FRAMES, values: Sequence[str] = ("p", "c"), key: str = KEY
) -> DataFrame:
    """Uniform linear resampling of every clip to ``length`` frames (frames 0..n-1 dense).

    A one-frame clip becomes constant. Confidences in ``c`` stay within 0..1 by linearity.
    """
    if length < 2:
        raise ValueError("the target needs at least two frames")
    ends = frames.groupBy(key).agg(F.max("frame").alias("_end"))
    params = ends.select(
        key, F.expr("array(0, _end)").alias("_source"), F.expr(f"array(0, {length - 1})").alias("_target"),
        F.col("_end").alias("_last"),
    )
    rows = join_per_key(frames, params, [key], "_last")
    return warp(rows, "_source", "_target", length, values, key).drop("_source", "_target")


def _anchored(frames: DataFrame, anchors: str) -> DataFrame:
    return frames.where(strictly_increasing(F.col(anchors))).withColumn(
        "_canonical", F.array(*[F.lit(a) for a in spec.CANONICAL_ANCHORS])
    )


def phase_align(
    frames: DataFrame, anchors: str = "anchors", values: Sequence[str] = ("p", "c"), key: str = KEY
) -> DataFrame:
    """Warp 64-frame clips so that their five anchors sit on the canonical frames.

    Clips whose anchors are not strictly increasing are left out; see
    :func:`anchor_errors`.
    """
    rows = _anchored(frames, anchors)
    return warp(rows, anchors, "_canonical", spec.CLIP_FRAMES, values, key).drop("_canonical")


def restore_timing(
    frames: DataFrame, anchors: str = "anchors", values: Sequence[str] = ("p",), key: str = KEY
) -> DataFrame:
    """Inverse of :func:`phase_align`: canonical frames back to the clip's own timing."""
    rows = _anchored(frames, anchors)
    return warp(rows, "_canonical", anchors, spec.CLIP_FRAMES, values, key).drop("_canonical")


# --- anchors ----------------------------------------------------------------------


def phase_anchors(start: Column, peak: Column, end: Column, length: int = spec.CLIP_FRAMES) -> Column:
    """Five anchor frames of the resampled clip (start, middle, peak, middle, end)."""
    middle = lambda a, b: F.floor((a + b) / 2)
    raw = (start, middle(start, peak), peak, middle(peak, end), end)
    scaled = [
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(float(length - 1)), F.rint((r - start) * (length - 1) / (end - start))),
        ).cast("int")
        for r in raw
    ]
    return F.array(*scaled)


def strictly_increasing(anchors: Column) -> Column:
    return (F.size(anchors) == 5) & F.forall(
        F.sequence(F.lit(1), F.lit(4)), lambda i: F.get(anchors, i) > F.get(anchors, i - 1)
    )


def ordered_inside(anchors: Column, length: int = spec.CLIP_FRAMES) -> Column:
    """Weaker rule of the feedback step: non-decreasing and inside the clip."""
    return (
        (F.size(anchors) == 5)
        & F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get(anchors, i) >= F.get(anchors, i - 1))
        & (F.get(anchors, 0) >= 0)
        & (F.get(anchors, 4) <= length - 1)
    )


def anchor_errors(clips: DataFrame, anchors: str = "anchors", key: str = KEY) -> DataFrame:
    return clips.where(~F.coalesce(strictly_increasing(F.col(anchors)), F.lit(False))).select(
        key, F.lit("phase anchors are not strictly increasing").alias("error")
    )


def clamp_window(windows: DataFrame, frames: str = "n") -> DataFrame:
    """Clamp start, peak and end into the clip and name what is wrong with the rest."""
    last = F.col(frames) - 1
    start = F.greatest(F.lit(0), F.least(last, F.col("start")))
    peak = F.greatest(start, F.least(last, F.col("peak")))
    end = F.greatest(peak, F.least(last, F.col("end")))
    error = (
        F.when(F.col(frames) < 5, "fewer than five tracked frames")
        .when(end - start < 4, "analysis window is too short")
        .otherwise("")
    )
    return windows.withColumns(
        {"start": start.cast("int"), "peak": peak.cast("int"), "end": end.cast("int"), "error": error}
    )


def valid_source_frames(source: Column, length: int = spec.CLIP_FRAMES) -> Column:
    """64 non-negative, non-decreasing source frames."""
    return (
        (F.size(source) == length)
        & F.forall(source, lambda v: v >= 0)
        & F.forall(
            F.sequence(F.lit(1), F.lit(length - 1)), lambda i: F.get(source, i) >= F.get(source, i - 1)
        )
    )


def source_frames_or_default(source: Column, length: int = spec.CLIP_FRAMES) -> Column:
    return F.coalesce(source, F.sequence(F.lit(0), F.lit(length - 1)))


# --- phases and key frames --------------------------------------------------------


def phase_of_frame(frame: Column, anchors: Column, skill: Column) -> Column:
    """Name of the phase a frame belongs to; the boundary rules differ by skill."""
    a1, a2, a3 = (F.get(anchors, i) for i in (1, 2, 3))
    lift = (
        F.when(frame < a1, "preparation").when(frame < a3, "backswing")
        .when(frame <= a3, "contact").otherwise("follow_through")
    )
    serve = (
        F.when(frame <= a1, "preparation").when(frame < a3, "weight_transfer")
        .when(frame <= a3, "contact").otherwise("follow_through")
    )
    overhead = (
        F.when(frame < a1, "preparation").when(frame < a2, "rotation")
        .when(frame <= a2, "contact").otherwise("follow_through")
    )
    return F.when(skill == "lift", lift).when(skill == "serve", serve).otherwise(overhead)


def checkpoint_role(frame: Column, anchors: Column, skill: Column) -> Column:
    """Role text of a frame on an anchor; of equal anchors the later one speaks."""
    roles = spec.by_skill(spec.CHECKPOINT_ROLES, skill)
    found = F.coalesce(
        *[F.when(F.get(anchors, i) == frame, F.get(roles, i)) for i in (4, 3, 2, 1, 0)]
    )
    return F.coalesce(found, F.lit(spec.BETWEEN_ANCHORS))


def keyframes(anchors: Column) -> Column:
    """Sorted distinct frames worth showing: anchors, midpoints and around the contact."""
    a = [F.get(anchors, i) for i in range(5)]
    middle = lambda x, y: F.floor((x + y) / 2).cast("int")
    around = [F.greatest(a[1], a[2] - 3), F.least(a[3], a[2] + 3)]
    wanted = [*a, *[middle(a[i], a[i + 1]) for i in range(4)], *around]
    return F.array_sort(F.array_distinct(F.array(*[w.cast("int") for w in wanted])))


def keyframe_plan(clips: DataFrame, fps: str = "fps", source: str = "source_frame_indices", key: str = KEY) -> DataFrame:
    """One row per clip and key frame: source frame, time stamp, phase and role."""
    rate = F.when(F.col(fps) > 0, F.col(fps)).otherwise(30.0)
    plan = clips.where(ordered_inside(F.col("anchors"))).withColumn(
        "frame", F.explode(keyframes(F.col("anchors")))
    )
    at = F.get(source_frames_or_default(F.col(source)), F.col("frame"))
    return plan.select(
        key,
        "skill",
        "frame",
        at.cast("int").alias("source_frame"),
        (at / rate).alias("timestamp_seconds"),
        phase_of_frame(F.col("frame"), F.col("anchors"), F.col("skill")).alias("phase"),
        checkpoint_role(F.col("frame"), F.col("anchors"), F.col("skill")).alias("role"),
    )


def pause_timeline(
    problems: DataFrame, clips: DataFrame, fps: Column, pause_seconds: float, key: str = KEY
) -> DataFrame:
    """Output frame list of a clip that pauses on frames with problems.

    A frame with problems is shown 1 + round(fps x pause) times (half to even).
    """
    marked = problems.groupBy(key, "frame").agg(F.count(F.lit(1)).alias("issues"))
    grid = clips.withColumn("frame", F.explode(F.array(*[F.lit(g) for g in range(spec.CLIP_FRAMES)])))
    extra = F.when(F.col("issues").isNotNull(), F.rint(fps * pause_seconds)).otherwise(0.0)
    return (
        grid.join(marked, [key, "frame"], "left")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), extra.cast("int"))))
        .select(key, "frame", "repeat", F.coalesce("issues", F.lit(0)).alias("issues"))
    )
