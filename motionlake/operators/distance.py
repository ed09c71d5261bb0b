"""Distances between a pose sequence and its correction.

Input is *pairs*: one row per (clip, frame) with source ``s`` and target ``t`` (51
coordinates each) and the shared confidence ``c`` (17). :func:`frame_terms` turns a
frame into its 17 joint, 12 bone and 8 angle terms in one pass; every distance below is
an aggregate of those terms, over the whole clip or over windows of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.columns import TINY
from motionlake.functions.ordered import exact_percentiles
from motionlake.functions.timeblocks import block_window, join_per_key, own_rows, with_halo

KEY = "clip_id"

JOINT, BONE, ANGLE = 0, 1, 2

_PARTS = (
    [(JOINT, j, j, j, j) for j in range(spec.JOINTS)]
    + [(BONE, k, a, b, b) for k, (a, b) in enumerate(spec.BONES)]
    + [(ANGLE, k, a, b, c) for k, (a, b, c) in enumerate(spec.ANGLE_TRIPLETS)]
)


def pairs(source: DataFrame, target: DataFrame, keys: Sequence[str] = (KEY, "frame"), merge: str = "source") -> DataFrame:
    """Equi-join two frame tables; confidence of the source, or 'product' of both."""
    other = target.select(*keys, F.col("p").alias("t"), F.col("c").alias("_c"))
    joined = source.withColumnRenamed("p", "s").join(other, list(keys))
    if merge == "product":
        joined = joined.withColumn("c", F.zip_with("c", "_c", lambda a, b: a * b))
    elif merge == "min":
        joined = joined.withColumn("c", F.zip_with("c", "_c", lambda a, b: F.least(a, b)))
    return joined.drop("_c")


def _length(array: str, a: str, b: str) -> str:
    d = lambda i: f"({array}[3*{a}+{i}] - {array}[3*{b}+{i}])"
    return f"sqrt({d(0)}*{d(0)} + {d(1)}*{d(1)} + {d(2)}*{d(2)})"


def _angle(dot: str, size: str, training: bool) -> str:
    if training:
        bounded = f"{dot} / greatest({size}, 1e-8D)"
        return f"acos(greatest(-0.999999D, least(0.999999D, {bounded})))"
    ratio = f"CASE WHEN {size} > 1e-8D THEN {dot} / {size} ELSE 1.0D END"
    return f"acos(greatest(-1.0D, least(1.0D, {ratio})))"


def frame_terms(
    pairs_: DataFrame, keys: Sequence[str] = (KEY,), training: bool = False
) -> DataFrame:
    """Rows (keys..., frame, kind, idx, ja, jb, jc, err, mask, verr, vmask).

    ``err``/``mask`` is the unweighted error and its confidence. Joint terms also carry
    the velocity error ``verr`` against the previous frame with mask ``vmask`` (null in
    the first frame).
    """
    w = block_window(keys)
    rows = own_rows(
        with_halo(pairs_.select(*keys, "frame", "s", "t", "c"), before=1).withColumns(
            {f"_{n}": F.lag(n).over(w) for n in ("s", "t", "c")}
        )
    )
    parts = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for v, n in zip(part, ("kind", "idx", "ja", "jb", "jc"))])
            for part in _PARTS
        ]
    )
    # Points, edges and products in steps of their own: each step compiles to a small method,
    # and a coordinate is looked up once a term.
    terms = (*keys, "frame", "kind", "idx", "ja", "jb", "jc")
    masks = ("ca", "cb", "cc", "_ca")
    points = rows.select("*", F.inline(parts)).selectExpr(
        *terms,
        *[f"{n}[3*j{j}+{i}] AS {n}{j}{i}" for n in "st" for j in "abc" for i in range(3)],
        *[f"{n}[3*ja+{i}] AS {n}a{i}" for n in ("_s", "_t") for i in range(3)],
        *[f"c[j{j}] AS c{j}" for j in "abc"],
        "_c[ja] AS _ca",
    )
    steps = points.selectExpr(
        *terms,
        *masks,
        *[f"sa{i} - ta{i} AS d{i}" for i in range(3)],
        *[f"(sa{i} - _sa{i}) - (ta{i} - _ta{i}) AS v{i}" for i in range(3)],
        *[f"{n}{j}{i} - {n}b{i} AS {n}{e}{i}" for n in "st" for e, j in zip("uv", "ac") for i in range(3)],
    )
    product = lambda p, q: f"{p}0*{q}0 + {p}1*{q}1 + {p}2*{q}2"
    sizes = steps.selectExpr(
        *terms,
        *masks,
        *[f"sqrt({product(n, n)}) AS {n}" for n in "dv"],
        *[f"sqrt({product(n + e, n + e)}) AS {n}{e}" for n in "st" for e in "uv"],
        *[f"{product(n + 'u', n + 'v')} AS {n}dot" for n in "st"],
    )
    angle = lambda n: _angle(f"{n}dot", f"({n}u * {n}v)", training)
    return sizes.selectExpr(
        *terms,
        f"CASE kind WHEN 0 THEN d WHEN 1 THEN abs(su - tu) ELSE abs({angle('s')} - {angle('t')}) / pi() END AS err",
        "CASE kind WHEN 0 THEN ca WHEN 1 THEN ca * cb ELSE ca * cb * cc END AS mask",
        "CASE WHEN kind = 0 AND _ca IS NOT NULL THEN v END AS verr",
        "CASE WHEN kind = 0 AND _ca IS NOT NULL THEN ca * _ca END AS vmask",
    )


def _mean(value: Column, mask: Column, condition: Column, weight: Column | None = None) -> Column:
    m = F.when(condition, mask if weight is None else mask * weight)
    total = F.coalesce(F.sum(m), F.lit(0.0))
    return F.when(total < TINY, 0.0).otherwise(F.sum(m * value) / total)


def component_means(
    terms: DataFrame, weights: Column, by: Sequence[str] = (KEY,), velocity_ok: Column | None = None
) -> DataFrame:
    """Position, angle, velocity and bone-length distance per group of terms.

    ``weights`` is the 17-element joint weight array. ``velocity_ok`` limits velocity
    terms to frames whose predecessor lies in the same window.
    """
    weight = F.get(weights, F.col("ja"))
    joint = F.col("kind") == JOINT
    moving = joint if velocity_ok is None else joint & velocity_ok
    err, mask = F.col("err"), F.col("mask")
    return terms.groupBy(*by).agg(
        _mean(err, mask, joint, weight).alias("position_distance"),
        _mean(err, mask, F.col("kind") == ANGLE).alias("angle_distance"),
        _mean(F.col("verr"), F.col("vmask"), moving, weight).alias("velocity_distance"),
        _mean(err, mask, F.col("kind") == BONE).alias("bone_length_distance"),
    )


def weighted_total(weights: Mapping[str, float] = spec.COMPONENT_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name in ("position", "angle", "velocity", "bone_length"):
        total = total + F.lit(float(weights[name])) * F.col(f"{name}_distance")
    return total


def distance_components(pairs_: DataFrame, keys: Sequence[str] = (KEY,), skill: str = "skill") -> DataFrame:
    """The four weighted components per clip; joint weights follow the clip's skill."""
    by = [*keys, skill]
    return component_means(frame_terms(pairs_, by), spec.joint_weight_array(skill), by)


def transition_components(
    pairs_: DataFrame, keys: Sequence[str] = (KEY,), by: Sequence[str] | None = None
) -> DataFrame:
    """Support transfer of the lower body and torso lean, both relative to frame 0.

    Means are pooled over ``by`` (default: one clip).

    First and last frame come from one partial aggregate per clip and meet the frames
    again through (clip, block) keys only for clips of any length.
    """
    keys = list(keys)
    by = keys if by is None else list(by)
    lean = lambda a: (
        f"atan2((({a}[17] + {a}[20]) - ({a}[35] + {a}[38])) * 0.5D,"
        f" (({a}[16] + {a}[19]) - ({a}[34] + {a}[37])) * 0.5D)"
    )
    rows = pairs_.selectExpr(
        *keys, "frame", "s", "t", "c",
        f"{lean('s')} AS ls", f"{lean('t')} AS lt", "c[5] * c[6] * c[11] * c[12] AS lc",
    )
    edge = F.struct("frame", "s", "t", "c", "ls", "lt", "lc")
    ends = rows.groupBy(*keys).agg(F.min(edge).alias("a"), F.max(edge).alias("z"))
    joined = join_per_key(
        rows, ends.withColumn("_last", F.col("z.frame")), keys, "_last"
    )
    joints = F.array(*[F.lit(j) for j in spec.TRANSITION_JOINTS])
    d = lambda i: f"((s[3*j+{i}] - a.s[3*j+{i}]) - (t[3*j+{i}] - a.t[3*j+{i}]))"
    per_joint = joined.select("*", F.explode(joints).alias("j")).selectExpr(
        *keys,
        "frame = z.frame AS at_end",
        "j = 11 AS once",
        f"sqrt({d(0)}*{d(0)} + {d(1)}*{d(1)} + {d(2)}*{d(2)}) AS err",
        "c[j] * a.c[j] AS mask",
        "abs((ls - a.ls) - (lt - a.lt)) AS lean_err",
        "lc * a.lc AS lean_mask",
    )
    always, end, once = F.lit(True), F.col("at_end"), F.col("once")
    parts = per_joint.groupBy(*by).agg(
        _mean(F.col("err"), F.col("mask"), always).alias("_path"),
        _mean(F.col("err"), F.col("mask"), end).alias("_end"),
        _mean(F.col("lean_err"), F.col("lean_mask"), once).alias("_lean_path"),
        _mean(F.col("lean_err"), F.col("lean_mask"), once & end).alias("_lean_end"),
    )
    lower = 0.5 * F.col("_path") + 0.5 * F.col("_end")
    torso = 0.5 * F.col("_lean_path") + 0.5 * F.col("_lean_end")
    return parts.select(
        *by,
        lower.alias("support_transition_distance"),
        torso.alias("torso_lean_transition_distance"),
        (0.65 * lower + 0.35 * torso).alias("transition_distance"),
    )


_TRANSITION = (
    "support_transition_distance",
    "torso_lean_transition_distance",
    "transition_distance",
)


def correction_distance(
    pairs_: DataFrame,
    keys: Sequence[str] = (KEY,),
    skill: str = "skill",
    weights: Mapping[str, float] = spec.COMPONENT_WEIGHTS,
) -> DataFrame:
    """All components and their weighted total per clip.

    Only skills with a transition weight pay for the transition pass.
    """
    keys = list(keys)
    base = distance_components(pairs_, keys, skill)
    with_transition = [s for s in spec.SKILLS if spec.TRANSITION_WEIGHT[s] > 0]
    moved = transition_components(pairs_.where(F.col(skill).isin(*with_transition)), keys)
    joined = base.join(moved, keys, "left").fillna(0.0, list(_TRANSITION))
    factor = spec.by_skill(spec.TRANSITION_WEIGHT, skill)
    return joined.withColumn(
        "correction_distance", weighted_total(weights) + factor * F.col("transition_distance")
    )


def keypoint_components(terms: DataFrame, by: Sequence[str] = (KEY,), velocity_ok: Column | None = None) -> DataFrame:
    """Distances credited to each of the 17 joints.

    An angle counts for its middle joint, a bone for both ends; a joint averages the
    angles and bones that were observed at all.
    """
    by = list(by)
    moving = F.lit(True) if velocity_ok is None else velocity_ok
    v = F.when(moving, F.col("vmask"))
    sums = terms.groupBy(*by, "kind", "idx", "ja", "jb").agg(
        F.sum(F.col("err") * F.col("mask")).alias("num"),
        F.sum("mask").alias("den"),
        F.sum(F.col("verr") * v).alias("vnum"),
        F.sum(v).alias("vden"),
    )
    owners = F.when(F.col("kind") == BONE, F.array("ja", "jb")).otherwise(F.array("jb"))
    owned = sums.withColumn("joint", F.explode(owners))
    mean = F.when(F.col("den") > TINY, F.col("num") / F.col("den"))
    of = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, mean)), F.lit(0.0))
    speed = F.sum(F.when((F.col("kind") == JOINT) & (F.col("vden") > TINY), F.col("vnum") / F.col("vden")))
    result = owned.groupBy(*by, "joint").agg(
        of(JOINT).alias("position_distance"),
        of(ANGLE).alias("angle_distance"),
        F.coalesce(speed, F.lit(0.0)).alias("velocity_distance"),
        of(BONE).alias("bone_length_distance"),
    )
    return result.withColumn("correction_distance", weighted_total())


def expand_windows(terms: DataFrame, windows: DataFrame, on: str = "skill") -> DataFrame:
    """Frames to every window [start, end) they lie in (a few fixed windows per skill)."""
    joined = terms.join(F.broadcast(windows), on)
    return joined.where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end")))


def quality_metrics(pairs_: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Stretching and jitter of the correction t - s."""
    keys = list(keys)
    w = block_window(keys)
    rows = own_rows(
        with_halo(pairs_.select(*keys, "frame", "s", "t", "c"), before=2).withColumns(
            {f"_{n}{k}": F.lag(n, k).over(w) for n in ("s", "t", "c") for k in (1, 2)}
        )
    )
    joints = F.array(*[F.lit(j) for j in range(spec.JOINTS)])
    at = lambda n, i: f"({'t' if not n else f'_t{n}'}[3*j+{i}] - {'s' if not n else f'_s{n}'}[3*j+{i}])"
    size = lambda e: "sqrt(" + " + ".join(f"pow({e(i)}, 2)" for i in range(3)) + ")"
    per_joint = rows.select("*", F.explode(joints).alias("j")).selectExpr(
        *keys,
        "CASE WHEN c[j] > 0 THEN " + size(lambda i: at(0, i)) + " END AS moved",
        size(lambda i: f"{at(0, i)} - {at(1, i)}") + " AS step",
        "c[j] * _c1[j] AS step_mask",
        size(lambda i: f"({at(0, i)} - {at(1, i)}) - ({at(1, i)} - {at(2, i)})") + " AS jerk",
        "c[j] * _c1[j] * _c2[j] AS jerk_mask",
    )
    motion = per_joint.groupBy(*keys).agg(
        F.coalesce(F.avg("moved"), F.lit(0.0)).alias("mean_joint_correction"),
        F.coalesce(F.max("moved"), F.lit(0.0)).alias("max_joint_correction"),
        _mean(F.col("step"), F.col("step_mask"), F.lit(True)).alias("mean_correction_velocity"),
        _mean(F.col("jerk"), F.col("jerk_mask"), F.lit(True)).alias("mean_correction_acceleration"),
    )
    ends = F.array(*[F.struct(F.lit(a).alias("ja"), F.lit(b).alias("jb")) for a, b in spec.BONES])
    bones = pairs_.select(*keys, "s", "t", "c", F.inline(ends)).where("c[ja] * c[jb] > 0").selectExpr(
        *keys,
        f"abs({_length('t', 'ja', 'jb')} - {_length('s', 'ja', 'jb')})"
        f" / greatest({_length('s', 'ja', 'jb')}, 0.1D) AS change",
    )
    stretch = bones.groupBy(*keys).agg(F.avg("change").alias("mean_relative_bone_change")).join(
        exact_percentiles(bones, keys, "change", {"p95_relative_bone_change": 0.95}), keys
    )
    return motion.join(stretch, keys, "left").fillna(
        0.0, ["mean_relative_bone_change", "p95_relative_bone_change"]
    )


def anchor_distances(pairs_: DataFrame, reach: int = 2, key: str = KEY, skill: str = "skill") -> DataFrame:
    """Correction distance within +-reach frames of each of the five anchors."""
    terms = frame_terms(pairs_, [key, skill])
    anchors = pairs_.groupBy(key).agg(F.first("anchors").alias("anchors")).select(
        key, F.posexplode("anchors").alias("phase", "anchor")
    )
    near = terms.join(anchors, key).where(
        (F.col("frame") >= F.col("anchor") - reach) & (F.col("frame") <= F.col("anchor") + reach)
    )
    first = F.greatest(F.lit(0), F.col("anchor") - reach)
    means = component_means(
        near, spec.joint_weight_array(skill), [key, skill, "phase", "anchor"], F.col("frame") > first
    )
    return means.withColumn("phase_distance", weighted_total())


def batch_losses(
    pairs_: DataFrame, batch: str, keys: Sequence[str] = (KEY,), skill: str = "skill"
) -> DataFrame:
    """Training-style loss per batch of pairs: own weights and a bounded cosine.

    Weighted means are pooled over the whole batch, as a batched tensor loss would be.
    A batch holds one skill; :func:`epoch_loss` averages over batches.
    """
    every = [*keys, skill, batch]
    by = [skill, batch]
    base = component_means(
        frame_terms(pairs_, every, training=True), spec.joint_weight_array(skill), by
    )
    with_transition = [s for s in spec.SKILLS if spec.TRANSITION_WEIGHT[s] > 0]
    moved = transition_components(pairs_.where(F.col(skill).isin(*with_transition)), every, by)
    joined = base.join(moved.select(*by, "transition_distance"), by, "left").fillna(
        0.0, ["transition_distance"]
    )
    factor = spec.by_skill(spec.TRANSITION_WEIGHT, skill)
    return joined.withColumn(
        "loss", weighted_total(spec.TRAINING_WEIGHTS) + factor * F.col("transition_distance")
    )


def epoch_loss(batches: DataFrame, by: Sequence[str] = ("skill",)) -> DataFrame:
    columns = [c for c in batches.columns if c == "loss" or c.endswith("_distance")]
    return batches.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("batches")
    )
