"""Operators on point tracks ``(track_id, frame, x, y)``.

Row-offset windows run over (track, block of frames) with a halo, so a single very
long track is spread over many tasks; argmax/argmin are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.ordered import exact_percentiles, first_by
from motionlake.functions.timeblocks import (
    block_window,
    box_mean,
    join_per_key,
    neighbours,
    own_rows,
    rows_in_interval,
    with_halo,
)

KEY = "track_id"


def _step(axes: Sequence[str], keys: Sequence[str], n: int = 1) -> Column:
    """Distance travelled over the last ``n`` frames; null for the first ``n``."""
    w = block_window(keys)
    squares = [F.pow(F.col(a) - F.lag(a, n).over(w), F.lit(2.0)) for a in axes]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return F.sqrt(total)


def moving_average(
    track: DataFrame,
    window: int = 5,
    pad: str = "edge",
    axes: Sequence[str] = ("x", "y"),
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Centred box mean of odd width; ends are padded by replication or reflection."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    if len(axes) < 2:
        raise ValueError("positions need at least two dimensions")
    half = window // 2
    if pad == "edge":
        rows = with_halo(track, before=half, after=half)
        return own_rows(
            rows.withColumns({f"{a}_smooth": box_mean(a, keys, window) for a in axes})
        )
    if pad != "reflect":
        raise ValueError("pad must be 'edge' or 'reflect'")
    # Reflection: frame -k shows frame k and frame n-1+k shows n-1-k, so the padding is
    # at most `half` extra rows at both ends of a track.
    last = track.groupBy(*keys).agg(F.max("frame").alias("_last"))
    tagged = track.join(last, list(keys))
    mirrored = F.array(
        F.col("frame") + half,
        F.when((F.col("frame") >= 1) & (F.col("frame") <= half), half - F.col("frame")),
        F.when(
            (F.col("frame") < F.col("_last")) & (F.col("frame") >= F.col("_last") - half),
            2 * F.col("_last") - F.col("frame") + half,
        ),
    )
    padded = tagged.withColumn("_at", F.explode(F.array_compact(mirrored))).withColumn("_copy", F.col("_at") != F.col("frame") + half)
    w = block_window(keys, "_at").rowsBetween(-half, half)
    rows = with_halo(padded, "_at", half, half)
    smooth = rows.withColumns({f"{a}_smooth": F.sum(a).over(w) / float(window) for a in axes})
    return own_rows(smooth, "_at").where(~F.col("_copy")).drop("_at", "_copy", "_last")


def velocity(
    track: DataFrame,
    dt: float = 1.0,
    n: int = 1,
    axes: Sequence[str] = ("x", "y"),
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """10 x distance over n frames / (n dt), one row per frame t = 0..N-n-1."""
    rows = with_halo(track, before=n).withColumn(
        "velocity", 10.0 * (_step(axes, keys, n) / (n * dt))
    )
    return (
        own_rows(rows)
        .where(F.col("velocity").isNotNull())
        .select(*keys, (F.col("frame") - n).alias("frame"), "velocity")
    )


def acceleration(
    speed: DataFrame, dt: float = 1.0, n: int = 1, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """10 x first difference of the speed / (n dt); always a one-step difference."""
    gap = F.col("velocity") - F.lag("velocity").over(block_window(keys))
    rows = with_halo(speed, before=1).withColumn("acceleration", 10.0 * (gap / (n * dt)))
    return (
        own_rows(rows)
        .where(F.col("acceleration").isNotNull())
        .select(*keys, (F.col("frame") - 1).alias("frame"), "acceleration")
    )


def _smooth_motion(
    track: DataFrame, window: int, keys: Sequence[str], axes: Sequence[str] = ("x", "y")
) -> DataFrame:
    """One pass: smooth, step length and change of step length per frame.

    ``speed`` at frame f is the step f-1 -> f, ``gain`` the change between the steps
    ending at f-1 and f. Both are null where undefined.
    """
    half = window // 2
    w = block_window(keys)
    rows = with_halo(track, before=half + 2, after=half)
    rows = rows.withColumns({f"_s_{a}": box_mean(a, keys, window) for a in axes})
    rows = rows.withColumn("speed", _step([f"_s_{a}" for a in axes], keys))
    # lags across a block edge read halo rows; rows whose own halo is cut are not ours
    rows = rows.withColumn("gain", F.col("speed") - F.lag("speed").over(w))
    return own_rows(rows)


def peak_window(
    track: DataFrame,
    before: int = spec.SEARCH_BEFORE,
    after: int = spec.SEARCH_AFTER,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Window around the largest acceleration of the smoothed track.

    First frame wins ties; tracks with fewer than three frames peak at frame 0.
    """
    half = spec.SMOOTHING // 2
    w = block_window(keys)
    rows = with_halo(track, before=half + 2, after=half)
    rows = rows.withColumns({f"_s_{a}": box_mean(a, keys, spec.SMOOTHING) for a in ("x", "y")})
    rows = rows.withColumn("_v", 10.0 * _step(["_s_x", "_s_y"], keys))
    rows = rows.withColumn("_a", 10.0 * (F.col("_v") - F.lag("_v").over(w)))
    best = own_rows(rows).groupBy(*keys).agg(
        F.min(
            F.when(F.col("_a").isNotNull(), F.struct((-F.col("_a")).alias("a"), "frame"))
        ).alias("_best"),
        F.count(F.lit(1)).alias("n"),
    )
    # acceleration index i belongs to frame i + 2 here, which is exactly the peak offset
    peak = F.coalesce(F.col("_best.frame"), F.lit(0))
    return best.select(
        *keys,
        F.greatest(F.lit(0), peak - before).cast("int").alias("start"),
        peak.cast("int").alias("peak"),
        F.least(F.col("n") - 1, peak + after).cast("int").alias("end"),
        F.col("n").cast("int").alias("n"),
    )


def _pick_extreme(
    rows: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    value: Column,
    name: str,
) -> DataFrame:
    """Frame of the smallest ``value`` within [low, high], first frame on ties."""
    inside = rows_in_interval(rows, bounds.select(*keys, low, high), keys, low, high)
    return inside.groupBy(*keys).agg(
        first_by(value.alias("v"), F.col("frame"), payload=[])["frame"].alias(name)
    )


def analysis_window(
    hand: DataFrame,
    elbow: DataFrame | None,
    skill: str = "skill",
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Start, peak and end of the motion for the skill named in column ``skill``.

    Clear and smash peak at the highest hand (smallest y), serve and lift at the lowest
    before the acceleration window closes. Tracks without an elbow and unknown skills
    give (-1, -1, -1).
    """
    keys = list(keys)
    skills = hand.groupBy(*keys).agg(F.first(skill).alias("skill"))
    acc = peak_window(hand, keys=keys).withColumnsRenamed(
        {"start": "acc_start", "peak": "acc_peak", "end": "acc_end"}
    )
    known = acc.join(skills, keys)
    if elbow is None:
        return known.select(
            *keys, "skill", *[F.lit(-1).alias(c) for c in ("start", "peak", "end")]
        )
    overhead = F.col("skill").isin("clear", "smash")
    low_hand = F.col("skill").isin("serve", "lift")
    known = known.withColumn(
        "search_end", F.when(overhead, F.col("acc_end")).otherwise(F.col("acc_end") - 1)
    )
    signed = hand.join(F.broadcast(_sign(hand.sparkSession)), hand[skill] == F.col("_skill"))
    peaks = _pick_extreme(
        signed.select(*keys, "frame", (F.col("y") * F.col("_sign")).alias("_v")),
        known, keys, "acc_start", "search_end", F.col("_v"), "found",
    )
    known = (
        known.join(peaks, keys, "left")
        .withColumn("peak", F.coalesce("found", "acc_peak"))
        .withColumn(
            "end_limit", F.when(F.col("skill") == "serve", F.col("n") - 1).otherwise(F.col("acc_end"))
        )
    )
    both = hand.select(*keys, "frame", F.col("y").alias("_hand_y"), F.col(skill).alias("_skill")).join(
        elbow.select(*keys, "frame", F.col("x").alias("_ex"), F.col("y").alias("_ey")),
        [*keys, "frame"],
        "left",
    )
    goal = (
        F.when(F.col("_skill") == "serve", F.col("_ey") - F.col("_ex"))
        .when(F.col("_skill") == "lift", F.col("_hand_y"))
        .otherwise(-F.col("_ey"))
    )
    ends = _pick_extreme(
        both.select(*keys, "frame", goal.alias("_v")),
        known, keys, "peak", "end_limit", F.col("_v"), "end_found",
    )
    known = known.join(ends, keys, "left").withColumn(
        "end0", F.coalesce("end_found", "peak")
    )
    end = F.when(
        F.col("end0") - F.col("peak") < 2, F.greatest("acc_end", F.col("peak") + 2)
    ).otherwise(F.col("end0"))
    end = F.least(F.col("n") - 1, end)
    end = F.when(F.col("skill") == "lift", F.greatest("peak", end)).otherwise(end)
    supported = overhead | low_hand
    return known.select(
        *keys,
        "skill",
        F.when(supported, F.greatest(F.lit(0), F.col("peak") - spec.SEARCH_BEFORE))
        .otherwise(-1).cast("int").alias("start"),
        F.when(supported, F.col("peak")).otherwise(-1).cast("int").alias("peak"),
        F.when(supported, end).otherwise(-1).cast("int").alias("end"),
    )


def _sign(spark) -> DataFrame:
    from motionlake.session import inline_table

    return inline_table(
        spark,
        [("clear", 1.0), ("smash", 1.0), ("serve", -1.0), ("lift", -1.0)],
        "_skill string, _sign double",
    )


def interpolate_gaps(
    track: DataFrame,
    valid: Column,
    values: Sequence[str] = ("x", "y"),
    keys: Sequence[str] = (KEY,),
    min_valid: int = 1,
    empty: float | None = 0.0,
) -> DataFrame:
    """Fill invalid rows linearly in ``frame``; ends hold the nearest valid value.

    With ``min_valid`` > 1 a track with fewer valid rows is dropped as a whole; a track
    without any valid row becomes ``empty``.
    """
    keys = list(keys)
    filled = neighbours(track, keys, valid, list(values))
    f, f0, f1 = F.col("frame"), F.col("_prev.at"), F.col("_next.at")
    columns = {}
    for v in values:
        v0, v1 = F.col(f"_prev.{v}"), F.col(f"_next.{v}")
        inner = F.when(f1 > f0, v0 + (v1 - v0) * ((f - f0) / (f1 - f0))).when(f1 == f0, v0)
        columns[v] = F.coalesce(inner, v0, v1, F.lit(empty))
    result = filled.withColumns(columns).drop("_prev", "_next")
    if min_valid <= 1:
        return result
    enough = track.groupBy(*keys).agg(
        F.sum(valid.cast("int")).alias("_n"), F.max("frame").alias("_last")
    )
    return join_per_key(result, enough.where(F.col("_n") >= min_valid).drop("_n"), keys, "_last")


def motion_score(
    track: DataFrame, axes: Sequence[str] = ("x", "y"), keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """p95 speed x p95 positive acceleration of the 3-point smoothed track.

    Tracks with fewer than 7 frames, or that never speed up, score 0.
    """
    keys = list(keys)
    motion = _smooth_motion(track, 3, keys, axes)
    sizes = motion.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kinds = motion.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("speed").alias("kind"), F.col("speed").alias("v")),
                F.struct(
                    F.lit("gain").alias("kind"),
                    F.when(F.col("gain") > 0, F.col("gain")).alias("v"),
                ),
            )
        ).alias("_m"),
    ).select(*keys, "_m.kind", "_m.v")
    top = exact_percentiles(kinds, [*keys, "kind"], "v", {"p95": 0.95})
    both = top.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "speed", F.col("p95"))).alias("_speed"),
        F.max(F.when(F.col("kind") == "gain", F.col("p95"))).alias("_gain"),
    )
    score = F.when(F.col("_n") < 7, 0.0).otherwise(
        F.coalesce(F.col("_speed") * F.col("_gain"), F.lit(0.0))
    )
    return sizes.join(both, keys, "left").select(*keys, score.alias("motion_score"))


def footwork_pattern(
    right: DataFrame, left: DataFrame, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Steps ``(frame, side)`` in order: a foot moving in this and the previous step.

    Moving means faster than mean minus population deviation of the smoothed speed.
    At one frame the right foot comes before the left (``seq`` 0, 1).
    """
    keys = list(keys)
    feet = right.withColumn("side", F.lit("R")).unionByName(left.withColumn("side", F.lit("L")))
    by = [*keys, "side"]
    speed = (
        _smooth_motion(feet, spec.SMOOTHING, by)
        .where(F.col("speed").isNotNull())
        .select(*by, (F.col("frame") - 1).alias("frame"), (10.0 * F.col("speed")).alias("v"))
    )
    limits = speed.groupBy(*by).agg(
        (F.avg("v") - F.stddev_pop("v")).alias("_limit"), F.max("frame").alias("_last")
    )
    moving = join_per_key(speed, limits, by, "_last").withColumn("_moving", F.col("v") > F.col("_limit"))
    held = with_halo(moving, before=1).withColumn(
        "_was", F.lag("_moving").over(block_window(by))
    )
    return (
        own_rows(held)
        .where(F.col("_moving") & F.col("_was"))
        .select(*keys, "frame", F.when(F.col("side") == "R", 0).otherwise(1).alias("seq"), "side")
    )


def step_sequences(steps: DataFrame, keys: Sequence[str] = (KEY,), part_frames: int = 16384) -> DataFrame:
    """Ordered list of sides per track, in parts of ``part_frames`` frames each.

    A list holds at most two steps per frame, so a row stays bounded however long the
    track is; the parts in order are the whole sequence.
    """
    ordered = F.array_sort(F.collect_list(F.struct("frame", "seq", "side")))
    part = F.floor(F.col("frame") / part_frames).cast("int")
    return steps.groupBy(*keys, part.alias("part")).agg(
        F.transform(ordered, lambda s: s["side"]).alias("pattern")
    )


def frame_intervals(track: DataFrame, ts: str = "ts", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Seconds since the previous frame; null at the first frame."""
    gap = (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(block_window(keys))) / 1e6
    return own_rows(with_halo(track, before=1).withColumn("interval", gap))


def nearest_frame(
    targets: DataFrame, tracked: DataFrame, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """For every target frame the nearest tracked frame; the lower one on ties."""
    keys = list(keys)
    union = targets.select(*keys, "frame", F.lit(False).alias("_tracked"), F.lit(1).alias("_n")).unionByName(
        tracked.select(*keys, "frame", F.lit(True).alias("_tracked"), F.lit(0).alias("_n"))
    )
    # one row per frame value, so the look-around windows have a unique order
    marks = union.groupBy(*keys, "frame").agg(
        F.max("_tracked").alias("_tracked"), F.sum("_n").alias("_targets")
    )
    near = neighbours(marks, keys, F.col("_tracked"), []).where(F.col("_targets") > 0)
    low, high, f = F.col("_prev.at"), F.col("_next.at"), F.col("frame")
    pick = F.when(low.isNull(), high).when(high.isNull(), low).otherwise(
        F.when(f - low <= high - f, low).otherwise(high)
    )
    return near.select(*keys, "frame", pick.alias("nearest"))
