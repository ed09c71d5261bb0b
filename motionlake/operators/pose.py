"""Operators on poses.

Two layouts: *joints* ``(clip_id, frame, joint, x, y, z, conf)`` and *frames*
``(clip_id, frame, p, c)`` where p holds 17 x 3 coordinates and c 17 confidences.
Geometry that mixes joints works on frames, where it is a projection without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.columns import norm
from motionlake.functions.ordered import exact_percentiles, number_rows
from motionlake.functions.timeblocks import BLOCK_FRAMES, join_per_key
from motionlake.operators.tracks import interpolate_gaps, motion_score
from motionlake.session import settle

KEY = "clip_id"
JOINT_COLUMNS = ("joint", "x", "y", "z", "conf")


# --- layouts ----------------------------------------------------------------------


def unpack(frames: DataFrame, p: str = "p", c: str = "c") -> DataFrame:
    """Frames -> joints; every other column is kept."""
    keep = [n for n in frames.columns if n not in (p, c)]
    return frames.select(
        *keep, p, c, F.explode(F.array(*[F.lit(j) for j in range(spec.JOINTS)])).alias("joint")
    ).select(
        *keep,
        "joint",
        F.expr(f"{p}[3 * joint]").alias("x"),
        F.expr(f"{p}[3 * joint + 1]").alias("y"),
        F.expr(f"{p}[3 * joint + 2]").alias("z"),
        F.expr(f"{c}[joint]").alias("conf"),
    )


def _by_joint(rows: DataFrame, keys: Sequence[str], entry: Column, ok: Column, first: Sequence[str] = ()) -> DataFrame:
    """Per key a map ``_m`` of joint to its largest entry; copies of a joint count once.

    Rows are dealt by key once, so both aggregations share one exchange, and the map has
    at most 17 entries whatever the copies. Keys without a usable row get an empty map.
    """
    dealt = rows.select(*keys, *first, F.when(ok, F.col("joint").cast("int")).alias("_joint"), F.when(ok, entry).alias("_e"))
    single = dealt.repartition(*keys).groupBy(*keys, "_joint").agg(
        F.max("_e").alias("_e"), *[F.first(k).alias(k) for k in first]
    )
    item = F.when(F.col("_joint").isNotNull(), F.struct("_joint", "_e"))
    return single.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(item)).alias("_m"), *[F.first(k).alias(k) for k in first]
    )


def pack(joints: DataFrame, keys: Sequence[str] = (KEY, "frame"), keep: Sequence[str] = ()) -> DataFrame:
    """Joints -> frames; absent joints become null.

    Of repeated rows of a joint the one with the largest (conf, x, y, z) counts.
    """
    entry = F.struct("conf", "x", "y", "z")
    inside = F.col("joint").between(0, spec.JOINTS - 1)
    grouped = _by_joint(joints.where(inside), keys, entry, inside, keep)
    return grouped.select(
        *keys,
        *keep,
        F.expr("flatten(transform(sequence(0, 16), j -> array(_m[j].x, _m[j].y, _m[j].z)))").alias("p"),
        F.expr("transform(sequence(0, 16), j -> coalesce(_m[j].conf, 0.0D))").alias("c"),
    )


def dense_joints(
    obs: DataFrame, dims: int = 3, keys: Sequence[str] = (KEY, "frame")
) -> DataFrame:
    """All 17 joints of every frame; unusable observations become null with conf 0.

    Joints outside 0..16 and rows with a missing or non-finite coordinate are ignored. Of
    repeated usable rows of a joint the one with the largest coordinates counts.
    """
    axes = ("x", "y", "z")[:dims]
    ok = F.col("joint").between(0, spec.JOINTS - 1)
    for a in axes:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    grouped = _by_joint(obs, keys, F.struct(*axes), ok)
    return grouped.select(
        *keys, "_m", F.explode(F.array(*[F.lit(j) for j in range(spec.JOINTS)])).alias("joint")
    ).select(
        *keys,
        "joint",
        *[F.col("_m")[F.col("joint")][a].alias(a) for a in axes],
        F.when(F.col("_m")[F.col("joint")].isNotNull(), 1.0).otherwise(0.0).alias("conf"),
    )


# --- rows -------------------------------------------------------------------------


def filter_confidence(obs: DataFrame, min_score: float = 0.5, max_joint: int | None = spec.JOINTS) -> DataFrame:
    """Joints scored strictly above the limit; frames without any simply vanish."""
    keep = F.col("score") > min_score
    if max_joint is not None:
        keep = keep & (F.col("joint") < max_joint)
    return obs.where(keep)


def default_scores(scores: Column, keypoints: Column) -> Column:
    """The score vector, or all ones when it is missing or of another length."""
    return F.when(F.size(scores) == F.size(keypoints), scores).otherwise(
        F.array_repeat(F.lit(1.0), F.size(keypoints))
    )


def pad_depth(point: Column) -> Column:
    """A 2-D or longer point as exactly three coordinates."""
    return F.array(
        F.get(point, 0), F.get(point, 1), F.coalesce(F.get(point, 2), F.lit(0.0))
    )


def to_camera(
    points: DataFrame,
    width: float,
    height: float,
    focal: float,
    person: Sequence[str] = (KEY, "frame", "person"),
) -> DataFrame:
    """Camera coordinates (x, y, z) from depth ``z`` and pixels ``px, py``.

    The lowest joint of each person is put at height 0.
    """
    depth = F.col("z") + spec.ROOT_DEPTH
    up = -((F.col("py") - height / 2.0) / focal * depth)
    raw = points.withColumns(
        {"_x": -((F.col("px") - width / 2.0) / focal * depth), "_y": depth, "_z": up}
    )
    floor_ = F.min("_z").over(Window.partitionBy(*person))
    return raw.withColumns({"x": F.col("_x"), "y": F.col("_y"), "z": F.col("_z") - floor_}).drop(
        "_x", "_y", "_z"
    )


def largest_person(detections: DataFrame, keys: Sequence[str] = (KEY, "frame"), order: Sequence[str] = ("person",)) -> DataFrame:
    """The detection with the largest box per frame; first one on ties.

    The rank limit is applied per task before the shuffle (window group limit).
    """
    side = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    area = F.coalesce(side("x0", "x1") * side("y0", "y1"), F.lit(-1.0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), *order))
    return detections.withColumn("area", area).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def boxes_from_keypoints(joints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of each person's keypoints."""
    return joints.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )


def retain_frames(
    joints3: DataFrame, joints2: DataFrame, require: Sequence[int] = (), key: str = KEY
) -> DataFrame:
    """Frames seen in both 2-D and 3-D (with the required joints), densely renumbered.

    ``source_frame`` keeps the number at capture.
    """
    need = set(require)

    def present(df: DataFrame) -> DataFrame:
        seen = df.groupBy(key, "frame").agg(
            *[F.max((F.col("joint") == j).cast("int")).alias(f"_j{j}") for j in sorted(need)] or [F.count(F.lit(1)).alias("_n")]
        )
        for j in sorted(need):
            seen = seen.where(F.col(f"_j{j}") == 1)
        return seen.select(key, "frame")

    both = present(joints3).join(present(joints2), [key, "frame"], "left_semi")
    return number_rows(
        both.withColumnRenamed("frame", "source_frame"),
        [key],
        ["source_frame"],
        F.floor(F.col("source_frame") / BLOCK_FRAMES),
        "frame",
    )


def remap_topology(frames: DataFrame, source: Sequence[int], p: str = "p", dims: int = 3) -> DataFrame:
    """Gather 17 joints from another skeleton; ``source[j]`` fills joint j."""
    parts = [F.get(p, dims * s + d) for s in source for d in range(dims)]
    return frames.withColumn(p, F.array(*parts))


def mirrored_joint(joint: Column) -> Column:
    """The opposite side's joint: odd slots are left, even slots right, 0 is the nose."""
    return F.when(joint == 0, joint).when(joint % 2 == 1, joint + 1).otherwise(joint - 1)


def mirror_left_right(joints: DataFrame, handedness: str = "handedness") -> DataFrame:
    """Swap sides of left-handed clips, so the dominant side is always the right slot.

    Applying it twice gives the physical side back.
    """
    joint = F.col("joint")
    return joints.withColumn(
        "joint", F.when(F.lower(handedness) == "left", mirrored_joint(joint)).otherwise(joint)
    )


def resolve_handedness(
    known: Column, override: Column, estimate: Column, filename: Column
) -> tuple[Column, Column]:
    """Handedness by precedence and the name of the source that decided."""
    fallback = F.when(F.lower(filename).contains("left"), "left").otherwise("right")
    value = F.coalesce(known, override, estimate, fallback)
    source = (
        F.when(known.isNotNull(), "known_metadata")
        .when(override.isNotNull(), "metadata_override")
        .when(estimate.isNotNull(), "wrist_motion")
        .otherwise("filename_fallback")
    )
    return value, source


def strict_handedness(requested: Column, estimate: Column) -> tuple[Column, Column]:
    """Requested hand unless 'auto'; an undecided estimate is an error, not a guess."""
    value = F.when(requested != "auto", requested).otherwise(estimate)
    error = F.when(value.isNull(), "handedness is ambiguous; rerun with right or left").otherwise("")
    return value, error


def sequence_identity(stem: Column, suffix: Column, prefix: str) -> tuple[Column, Column]:
    if "/" in prefix or "\\" in prefix:
        raise ValueError("the id prefix must not contain a path separator")
    name = F.concat(F.lit(prefix), stem)
    return name, F.concat(name, F.lower(suffix))


def missing_joint_ratio(joints: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return joints.groupBy(*keys).agg((1 - F.avg("conf")).alias("missing_joint_ratio"))


def missing_torso(joints: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Clips that never show one of the shoulders or hips, with the first such joint."""
    seen = joints.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("joint") == j) & (F.col("conf") > 0), 1).otherwise(0)).alias(f"_j{j}")
            for j in spec.LEAN_JOINTS
        ]
    )
    first = F.coalesce(*[F.when(F.col(f"_j{j}") == 0, j) for j in spec.LEAN_JOINTS])
    return seen.select(*keys, first.alias("missing_joint")).where(F.col("missing_joint").isNotNull())


def merge_confidence(a: DataFrame, b: DataFrame, keys: Sequence[str] = (KEY, "frame", "joint")) -> DataFrame:
    """Smaller of two confidences of the same joint; coordinates of ``a``."""
    other = b.select(*keys, F.col("conf").alias("_other"))
    return a.join(other, list(keys)).withColumn("conf", F.least("conf", "_other")).drop("_other")


# --- angles -----------------------------------------------------------------------


def named_angles(frames: DataFrame, angles: Mapping[str, tuple[int, int, int]] = spec.NAMED_ANGLES) -> DataFrame:
    """Map of joint angles in degrees; missing joints or zero-length sides give 0."""
    entries = []
    for name, (a, b, c) in angles.items():
        u = [f"(p[{3*a+d}] - p[{3*b+d}])" for d in range(3)]
        v = [f"(p[{3*c+d}] - p[{3*b+d}])" for d in range(3)]
        dot = " + ".join(f"{i} * {j}" for i, j in zip(u, v))
        size = f"(sqrt({' + '.join(f'{i}*{i}' for i in u)}) * sqrt({' + '.join(f'{i}*{i}' for i in v)}))"
        angle = F.expr(
            f"coalesce(CASE WHEN {size} > 0 AND c[{a}] > 0 AND c[{b}] > 0 AND c[{c}] > 0 THEN "
            f"degrees(acos(greatest(-1.0D, least(1.0D, ({dot}) / {size})))) END, 0.0D)"
        )
        entries += [F.lit(name), angle]
    return frames.withColumn("angles", F.create_map(*entries))


def mirror_angle_names(angles: Column) -> Column:
    """Exchange Left and Right in the keys of an angle map; other keys stay."""
    def swap(k: Column, _: Column) -> Column:
        return (
            F.when(k.contains("Left"), F.regexp_replace(k, "Left", "Right"))
            .otherwise(F.regexp_replace(k, "Right", "Left"))
        )

    known = F.array(*[F.lit(n) for n in spec.NAMED_ANGLES])
    return F.transform_keys(
        angles, lambda k, v: F.when(F.array_contains(known, k), swap(k, v)).otherwise(k)
    )


def torso_lean(frames: DataFrame, p: str = "p", name: str = "lean") -> DataFrame:
    """Signed forward lean atan2(z, y) of shoulder centre over hip centre."""
    axis = lambda d: f"(({p}[{15+d}] + {p}[{18+d}]) - ({p}[{33+d}] + {p}[{36+d}])) * 0.5D"
    return frames.withColumn(name, F.expr(f"atan2({axis(2)}, {axis(1)})"))


# --- normalisation ----------------------------------------------------------------


def fill_joints(joints: DataFrame, key: str = KEY) -> DataFrame:
    """Gap-filled coordinates; confidences stay the original observation mask."""
    ok = F.col("conf") > 0
    for a in ("x", "y", "z"):
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a)
    return interpolate_gaps(joints, ok, ("x", "y", "z"), (key, "joint"))


def _basis(frames: DataFrame, dims: int, search: bool) -> DataFrame:
    """Columns _x, _y, _z (axes) and _ok of every frame."""
    at = lambda j, d: f"p[{3*j+d}]"
    base = frames.selectExpr(
        "*",
        *[f"{at(6,d)} - {at(5,d)} AS _u{d}" for d in range(3)],
        *[
            f"({at(5,d)} + {at(6,d)}) / 2.0D - ({at(11,d)} + {at(12,d)}) / 2.0D AS _s{d}"
            for d in range(3)
        ],
    )
    base = base.selectExpr("*", "sqrt(_u0*_u0 + _u1*_u1 + _u2*_u2) AS _w")
    floor_ = "_w" if search else "greatest(_w, 1e-8D)"
    # a degenerate frame has no axes: null, not an error, and never picked
    base = base.selectExpr("*", *[f"try_divide(_u{d}, {floor_}) AS _x{d}" for d in range(3)])
    base = base.selectExpr("*", "_s0*_x0 + _s1*_x1 + _s2*_x2 AS _dot")
    base = base.selectExpr("*", *[f"_s{d} - _dot * _x{d} AS _t{d}" for d in range(3)])
    base = base.selectExpr("*", "sqrt(_t0*_t0 + _t1*_t1 + _t2*_t2) AS _h")
    if not search:
        y = [f"_t{d} / greatest(_h, 1e-8D)" for d in range(3)]
        ok = "true"
    elif dims == 2:
        flat = ("-_x1", "_x0", "0.0D")
        y = [f"CASE WHEN _h < 1e-8D THEN {flat[d]} ELSE try_divide(_t{d}, _h) END" for d in range(3)]
        ok = "_w >= 1e-8D"
    else:
        y = [f"try_divide(_t{d}, _h)" for d in range(3)]
        ok = "_w >= 1e-8D AND _h >= 1e-8D"
    base = base.selectExpr("*", *[f"{y[d]} AS _y{d}" for d in range(3)], f"({ok}) AS _ok")
    base = base.selectExpr(
        "*",
        "_x1*_y2 - _x2*_y1 AS _z0",
        "_x2*_y0 - _x0*_y2 AS _z1",
        "_x0*_y1 - _x1*_y0 AS _z2",
    )
    base = base.selectExpr("*", "greatest(sqrt(_z0*_z0 + _z1*_z1 + _z2*_z2), 1e-8D) AS _zn")
    axes = ", ".join(
        [f"_x{d}" for d in range(3)] + [f"_y{d}" for d in range(3)] + [f"_z{d} / _zn" for d in range(3)]
    )
    return base.selectExpr(*frames.columns, "_ok", f"array({axes}) AS _axes")


def bone_lengths(frames: DataFrame, keys: Sequence[str] = (KEY, "frame")) -> DataFrame:
    """One row per frame and bone: length and whether both ends were observed."""
    ends = F.array(*[F.struct(F.lit(k).alias("bone"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(spec.BONES)])
    return frames.select(*keys, "p", "c", F.inline(ends)).selectExpr(
        *keys,
        "bone",
        "sqrt(pow(p[3*a] - p[3*b], 2) + pow(p[3*a+1] - p[3*b+1], 2) + pow(p[3*a+2] - p[3*b+2], 2)) AS length",
        "(c[a] > 0 AND c[b] > 0) AS observed",
    )


def _median_bone(frames: DataFrame, key: str) -> DataFrame:
    usable = bone_lengths(frames).where(F.col("observed") & (F.col("length") > 1e-8))
    return exact_percentiles(usable, [key], "length", {"_median": 0.5})


def body_scale(frames: DataFrame, key: str = KEY) -> DataFrame:
    """Median observed bone length per clip (exact, distributed), 1 where none is usable."""
    clips = frames.select(key).distinct()
    return clips.join(_median_bone(frames, key), key, "left").select(
        key, F.coalesce("_median", F.lit(1.0)).alias("scale")
    )


def normalize_pose(
    joints: DataFrame,
    handedness: str = "handedness",
    dims: int = 3,
    basis: str = "first_valid",
    key: str = KEY,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Body-frame coordinates: fill gaps, canonical side, pelvis origin, body axes, unit scale.

    ``basis='first_valid'`` takes the axes of the earliest non-degenerate frame (identity
    when there is none), ``'first'`` those of frame 0 with floored norms. ``keep`` names
    per-clip columns to carry along.
    """
    filled = fill_joints(joints, key)
    # read three times below: for the axes, the bone lengths and the result
    frames = settle(pack(mirror_left_right(filled, handedness), (key, "frame"), keep=[handedness, *keep]))
    search = basis == "first_valid"
    marked = _basis(frames, dims, search)
    if not search:
        marked = marked.withColumn("_ok", F.col("frame") == 0)
    axes = marked.groupBy(key).agg(
        F.min(F.when(F.col("_ok"), F.struct("frame", "_axes"))).alias("_pick"),
        F.max("frame").alias("_last"),
    )
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    params = axes.join(_median_bone(frames, key), key, "left").select(
        key,
        F.coalesce(F.col("_pick._axes"), identity).alias("_axes"),
        F.coalesce("_median", F.lit(1.0)).alias("scale"),
        "_last",
    )
    flip = F.when(F.lower(handedness) == "left", -1.0).otherwise(1.0) if dims == 3 else F.lit(1.0)
    joined = join_per_key(frames, params, [key], "_last").withColumn("_flip", flip)
    row = lambda i: (
        f"(_axes[{3*i}] * (p[3*j] - (p[33]+p[36])/2.0D) + _axes[{3*i+1}] * (p[3*j+1] - (p[34]+p[37])/2.0D)"
        f" + _axes[{3*i+2}] * (p[3*j+2] - (p[35]+p[38])/2.0D)) / scale"
    )
    return joined.withColumn(
        "p", F.expr(f"flatten(transform(sequence(0, 16), j -> array({row(0)}, {row(1)}, _flip * {row(2)})))")
    ).drop("_axes", "_flip", "scale")


# --- handedness -------------------------------------------------------------------


def dominant_track(
    joints: DataFrame, handedness: str, part: str, threshold: float = 0.05, key: str = KEY
) -> DataFrame:
    """Gap-filled wrist or elbow track of the dominant side; too sparse clips are absent."""
    left, right = {"wrist": (9, 10), "elbow": (7, 8)}[part]
    side = F.when(F.lower(handedness) == "left", left).otherwise(right)
    rows = joints.where(F.col("joint") == side)
    return _dense_track(rows, [key], threshold)


def _dense_track(rows: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    ok = (F.col("conf") > threshold) & F.col("x").isNotNull() & F.col("y").isNotNull()
    return interpolate_gaps(rows, ok, ("x", "y"), keys, min_valid=2, empty=None)


def estimate_handedness(
    joints: DataFrame, min_ratio: float = 2.0, key: str = KEY, threshold: float = 0.05
) -> DataFrame:
    """Dominant hand from scale-free peak wrist motion; null when undecided.

    Needs wrists, shoulders and hips with two observed frames each, and two frames with
    a visible shoulder width; otherwise scores are 0 and the ratio is 1.
    """
    if min_ratio <= 1.0:
        raise ValueError("the minimum ratio must be greater than one")
    parts = (9, 10, 5, 6, 11, 12)
    dense = _dense_track(joints.where(F.col("joint").isin(*parts)), [key, "joint"], threshold)
    pick = lambda j, a: F.max(F.when(F.col("joint") == j, F.col(a))).alias(f"{a}{j}")
    wide = dense.groupBy(key, "frame").agg(
        *[pick(j, a) for j in parts for a in ("x", "y")], F.count(F.lit(1)).alias("_parts")
    ).where(F.col("_parts") == len(parts))
    width = norm(F.col("x6") - F.col("x5"), F.col("y6") - F.col("y5"))
    # read four times below: keep the six joints instead of filling their gaps again
    wide = settle(wide.withColumn("_width", width))
    usable = wide.where(F.col("_width") > 1e-8)
    median = exact_percentiles(usable, [key], "_width", {"_median": 0.5})
    enough = wide.groupBy(key).agg(
        F.sum((F.col("_width") > 1e-8).cast("int")).alias("_n"), F.max("frame").alias("_last")
    ).where(F.col("_n") >= 2)
    scaled = join_per_key(wide, enough.join(median, key).drop("_n"), [key], "_last")
    size = F.when(F.col("_width") > 1e-8, F.col("_width")).otherwise(F.col("_median"))
    centre = lambda a: (F.col(f"{a}5") + F.col(f"{a}6") + F.col(f"{a}11") + F.col(f"{a}12")) / 4.0
    hands = scaled.select(
        key,
        "frame",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias("side"),
                        ((F.col(f"x{j}") - centre("x")) / size).alias("x"),
                        ((F.col(f"y{j}") - centre("y")) / size).alias("y"),
                    )
                    for side, j in (("left", 9), ("right", 10))
                ]
            )
        ).alias("_h"),
    ).select(key, "frame", "_h.side", "_h.x", "_h.y")
    scores = motion_score(hands, ("x", "y"), (key, "side")).groupBy(key).agg(
        F.max(F.when(F.col("side") == "left", F.col("motion_score"))).alias("_l"),
        F.max(F.when(F.col("side") == "right", F.col("motion_score"))).alias("_r"),
    )
    left = F.coalesce("_l", F.lit(0.0))
    right = F.coalesce("_r", F.lit(0.0))
    larger, smaller = F.greatest(left, right), F.least(left, right)
    ratio = F.when(F.col("_l").isNull(), 1.0).otherwise(larger / F.greatest(smaller, F.lit(1e-12)))
    hand = F.when((larger > 1e-12) & (ratio >= min_ratio), F.when(left > right, "left").otherwise("right"))
    return joints.select(key).distinct().join(scores, key, "left").select(
        key,
        hand.alias("handedness"),
        left.alias("left_motion_score"),
        right.alias("right_motion_score"),
        ratio.alias("confidence_ratio"),
    )
