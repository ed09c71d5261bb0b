"""Calibration, grades, criteria, per-joint evidence and score tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionlake import spec
from motionlake.functions.columns import TINY, direction, file_stem, score
from motionlake.functions.ordered import exact_percentiles, percentile_table, running_totals
from motionlake.operators import distance as D
from motionlake.session import inline_table, settle, ship_package

KEY = "clip_id"
ALPHA_LIMIT = float(1 << 20)
GRID = 201
#: Steepnesses of the first pass, and steps between two of them in the second.
RUNGS = (0.0, *(2.0**k for k in range(-2, 21)))
STEPS = 8
#: Powers of the distance that are summed beside the exponential.
POWERS = 8
#: Groups up to which their offsets are broadcast (some kilobytes each).
BROADCAST_GROUPS = 4096


# --- calibration ------------------------------------------------------------------


def fit_calibration(
    distances: DataFrame,
    by: str = "skill",
    label: str = "label",
    value: str = "correction_distance",
    target_beginner: float = 45.0,
    target_expert: float = 99.0,
) -> DataFrame:
    """Offset and steepness per group so that both cohorts reach their target means.

    Candidate offsets are 0 and 201 expert quantiles. For every offset the steepness
    solves mean(100 exp(-alpha max(d - offset, 0))) = target over the beginners; the offset
    with the smallest distance of both means from their targets wins, the smaller one on ties.

    All offsets of a group share their sums: a distance counts once per steepness, in the
    interval between two offsets it lies in, and running sums from the last interval down
    give the mean of every offset. A first pass over a ladder of steepnesses finds the octave
    of each root, a second one over ``STEPS`` steepnesses of the octaves found sums powers of
    the distance as well, so that root and means follow from a short series around the
    nearest step (off by less than 1e-10). Both passes are partial aggregations; the running
    sums and roots of one group are one small task (202 offsets, some tens of steepnesses).
    One row per group comes back.
    """
    ship_package(distances.sparkSession)
    experts = distances.where(F.col(label) == "experts")
    grid = percentile_table(experts, [by], value, [i / (GRID - 1) for i in range(GRID)]).select(by, F.col("quantile").alias("o"))
    zero = experts.where(F.col(value).isNotNull()).select(by, F.lit(0.0).alias("o")).distinct()
    grid = settle(grid.unionByName(zero).groupBy(by).agg(F.sort_array(F.collect_set("o")).alias("offsets")))
    small = grid.count() <= BROADCAST_GROUPS
    near = F.broadcast if small else (lambda t: t)

    def placed(name: str) -> DataFrame:
        counted = distances.where((F.col(label) == name) & F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        rows = counted.join(near(grid), by)
        j = F.size(F.filter("offsets", lambda o: o <= F.col("d"))) - 1
        return rows.withColumn("j", j).select(by, "j", "n", F.when(F.col("j") >= 0, F.col("d") - F.get("offsets", F.col("j"))).otherwise(0.0).alias("a"))

    sides = settle(placed("beginners").withColumn("side", F.lit(0)).unionByName(placed("experts").withColumn("side", F.lit(1))))
    kind = distances.schema[by].dataType
    found_schema = T.StructType([T.StructField(by, kind), *(T.StructField(n, t) for n, t in (("j", T.IntegerType()), ("low", T.DoubleType()), ("high", T.DoubleType())))])
    target = target_beginner / 100.0

    def first(offsets: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        return _octaves(offsets, sums, target, by)

    def second(octaves: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        return _best_offset(octaves, sums, target_beginner, target_expert, by)

    ladder = _interval_sums(sides.where("side = 0").withColumn("alphas", F.array(*map(F.lit, RUNGS))), by, 2)
    octaves = settle(grid.groupBy(by).cogroup(ladder.groupBy(by)).applyInPandas(first, found_schema))
    steps = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.when(
        F.col("low") > 0, F.col("low") * F.pow(F.col("high") / F.col("low"), i / float(STEPS))).otherwise(F.col("high") * i / float(STEPS)))
    wanted = octaves.select(by, "low", "high").distinct().groupBy(by).agg(F.array_distinct(F.flatten(F.collect_list(steps))).alias("alphas"))
    fine = _interval_sums(sides.join(near(wanted), by), by, POWERS)
    both = octaves.join(near(grid.select(by, F.posexplode("offsets").alias("j", "o"))), [by, "j"])
    schema = T.StructType([
        T.StructField(by, kind), *(T.StructField(n, T.DoubleType()) for n in ("distance_offset", "alpha", "target_beginner_mean", "target_expert_mean")),
        T.StructField("target_reachable", T.BooleanType()),
    ])
    rows = [tuple(r) for r in both.groupBy(by).cogroup(fine.groupBy(by)).applyInPandas(second, schema).orderBy(by).collect()]
    if not rows:
        raise ValueError("expert and beginner distances are required for calibration")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return inline_table(distances.sparkSession, rows, columns)


def _interval_sums(rows: DataFrame, by: str, powers: int) -> DataFrame:
    """(side, j, alpha, n, z, m0, m1, ...): sums of n a**k exp(-alpha a) per interval.

    ``a`` is the distance from the interval's offset, ``z`` counts what lies on it.
    """
    each = rows.select(by, "side", "j", "n", "a", F.explode("alphas").alias("alpha"))
    e = F.col("n") * F.exp(-F.col("alpha") * F.col("a"))
    terms = [e]
    for _ in range(1, powers):
        terms.append(terms[-1] * F.col("a"))
    return each.groupBy(by, "side", "j", "alpha").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("a") == 0, F.col("n")).otherwise(0)).alias("z"),
        *[F.sum(t).alias(f"m{k}") for k, t in enumerate(terms)],
    )


def _over_offsets(sums: pd.DataFrame, offsets: np.ndarray, powers: int) -> dict[float, np.ndarray]:
    """Per steepness the sums of (max(d - o, 0))**k exp(...) for all offsets: (offsets, powers).

    Distances at or below an offset count as e = 1 in the first sum.
    """
    names = [f"m{k}" for k in range(powers)]
    alphas, row = np.unique(sums["alpha"].to_numpy(dtype=float), return_inverse=True)
    j = sums["j"].to_numpy()
    own, n = np.zeros((len(alphas), len(offsets), powers)), np.zeros((len(alphas), len(offsets) + 1))
    n[row, j + 1] = sums["n"].to_numpy(dtype=float)
    inside = j >= 0
    own[row[inside], j[inside]] = sums[names].to_numpy(dtype=float)[inside]
    # Binomial weights of (a + gap)**k in the powers of a.
    weights = np.array([[math.comb(k, i) for i in range(powers)] for k in range(powers)], dtype=float)
    lift = np.maximum(np.subtract.outer(np.arange(powers), np.arange(powers)), 0)
    above = np.empty_like(own)
    after = np.zeros((len(alphas), powers))
    for at in range(len(offsets) - 1, -1, -1):
        if at + 1 < len(offsets):
            gap = offsets[at + 1] - offsets[at]
            after = np.exp(-alphas * gap)[:, None] * (after @ (weights * gap**lift).T)
        after = after + own[:, at]
        above[:, at] = after
    above[:, :, 0] += np.cumsum(n, axis=1)[:, :-1]
    return {float(alpha): above[k] for k, alpha in enumerate(alphas)}


def _octaves(offsets: pd.DataFrame, sums: pd.DataFrame, target: float, by: str) -> pd.DataFrame:
    """Per offset the two rungs around its root; equal ones where there is none to look for."""
    columns = [by, "j", "low", "high"]
    if not len(offsets) or not len(sums):
        return pd.DataFrame(columns=columns)
    grid = np.asarray(offsets["offsets"].iloc[0], dtype=float)
    total = float(sums.loc[sums["alpha"] == 0, "n"].sum())
    means = _over_offsets(sums, grid, 2)
    zero = sums[sums["alpha"] == 0].groupby("j")[["n", "z"]].sum()
    n, z = np.zeros(len(grid) + 1), np.zeros(len(grid) + 1)
    n[zero.index.to_numpy() + 1], z[zero.index.to_numpy() + 1] = zero["n"], zero["z"]
    on = np.cumsum(n)[:-1] + z[1:]
    rows = []
    for j in range(len(grid)):
        if on[j] > target * total:
            low = high = ALPHA_LIMIT
        elif on[j] >= total:
            low = high = 0.0
        else:
            above = [r for r in RUNGS if means[r][j, 0] >= target * total]
            low = max(above, default=0.0)
            at = RUNGS.index(low)
            high = RUNGS[min(at + 1, len(RUNGS) - 1)]
        rows.append((offsets[by].iloc[0], j, low, high))
    return pd.DataFrame(rows, columns=columns)


def _series(moments: np.ndarray, step: float) -> tuple[float, float]:
    """Value and slope at ``alpha + step`` from the sums at ``alpha``."""
    value = sum(m * (-step) ** k / math.factorial(k) for k, m in enumerate(moments))
    slope = -sum(m * (-step) ** (k - 1) / math.factorial(k - 1) for k, m in enumerate(moments) if k)
    return value, slope


def _best_offset(octaves: pd.DataFrame, sums: pd.DataFrame, target_beginner: float, target_expert: float, by: str) -> pd.DataFrame:
    """The winning offset of a group with its steepness."""
    columns = [by, "distance_offset", "alpha", "target_beginner_mean", "target_expert_mean", "target_reachable"]
    if not len(octaves) or not len(sums) or sums["side"].nunique() < 2:
        return pd.DataFrame(columns=columns)
    octaves = octaves.sort_values("j")
    grid = octaves["o"].to_numpy(dtype=float)
    sides = [sums[sums["side"] == side] for side in (0, 1)]
    total = [float(s.loc[s["alpha"] == s["alpha"].iloc[0], "n"].sum()) for s in sides]
    low, high = (_over_offsets(s, grid, POWERS) for s in sides)
    steps = np.array(sorted(low))
    best = None
    for j, (a, b) in enumerate(zip(octaves["low"], octaves["high"])):
        ok = not (a == b == ALPHA_LIMIT)
        alpha, near = float(a), float(a)
        if a < b:
            inside = steps[(steps >= a) & (steps <= b)]
            want = target_beginner / 100.0 * total[0]
            above = [s for s in inside if low[s][j, 0] >= want]
            left = max(above, default=inside[0])
            right = min((s for s in inside if s > left), default=left)
            near = left if low[left][j, 0] - want <= want - low[right][j, 0] else right
            alpha = float(near)
            for _ in range(50):
                value, slope = _series(low[near][j], alpha - near)
                move = (want - value) / slope if slope else 0.0
                alpha = min(max(alpha + move, 0.0), ALPHA_LIMIT)
                if abs(move) <= 1e-15 * max(alpha, 1e-300):
                    break
        elif near not in low:
            near = float(steps[np.abs(steps - near).argmin()])
        achieved, mean = (100.0 * _series(m[near][j], alpha - near)[0] / n for m, n in ((low, total[0]), (high, total[1])))
        objective = abs(mean - target_expert) + abs(achieved - target_beginner) + (0.0 if ok else 100.0)
        if best is None or objective < best[0]:
            best = objective, float(grid[j]), alpha, ok
    _, offset, alpha, ok = best
    return pd.DataFrame([(octaves[by].iloc[0], offset, alpha, float(target_beginner), float(target_expert), ok)], columns=columns)


def with_scores(
    distances: DataFrame, calibration: DataFrame, by: str = "skill",
    value: str = "correction_distance", name: str = "total_grade",
) -> DataFrame:
    params = calibration.select(by, "distance_offset", "alpha")
    joined = distances.join(F.broadcast(params), by)
    return joined.withColumn(
        name, score(F.col(value), F.col("distance_offset"), F.col("alpha"))
    ).drop("distance_offset", "alpha")


# --- criteria ---------------------------------------------------------------------


def criterion_distances(
    pairs_: DataFrame, key: str = KEY, skill: str = "skill", terms: DataFrame | None = None
) -> DataFrame:
    """Distance of every criterion window: (clip, k, name, maximum, distance).

    Windows with a joint list use the plain mean joint error, windows without the full
    weighted distance, and the weight transfer the whole-clip transition.
    """
    spark = pairs_.sparkSession
    terms = D.frame_terms(pairs_, [key, skill]) if terms is None else terms
    table = spec.criteria(spark)
    rows = D.expand_windows(terms, table.where("metric <> 'full_transition'"), skill)
    listed = F.col("joints").isNotNull()
    plain = listed & (F.col("kind") == D.JOINT) & F.array_contains("joints", F.col("ja"))
    rows = rows.where(~listed | plain)
    moving = F.col("frame") > F.col("start")
    by = [key, skill, "k"]
    weight = F.when(listed, F.array_repeat(F.lit(1.0), spec.JOINTS)).otherwise(spec.joint_weight_array(skill))
    parts = D.component_means(rows.withColumn("_w", weight), F.col("_w"), by, moving)
    totals = parts.join(F.broadcast(table), [skill, "k"]).withColumn(
        "distance",
        F.when(F.col("joints").isNotNull(), F.col("position_distance")).otherwise(D.weighted_total()),
    )
    whole = table.where("metric = 'full_transition'")
    moved = D.transition_components(
        pairs_.join(F.broadcast(whole.select(skill).distinct()), skill, "left_semi"), [key, skill]
    ).join(F.broadcast(whole), skill).withColumn("distance", F.col("transition_distance"))
    columns = [key, skill, "k", "rule_id", "name", "maximum", "distance"]
    return totals.select(*columns).unionByName(moved.select(*columns))


def reconcile(criteria: DataFrame, total: str = "total_grade", grade: str = "grade", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Scale criterion grades of a clip (at most six rows) so that they sum to its total.

    Too much is shrunk proportionally, too little is shared by remaining capacity.
    """
    w = Window.partitionBy(*keys)
    raw = F.sum(grade).over(w)
    room = F.col("maximum") - F.col(grade)
    room_total = F.sum(room).over(w)
    return criteria.withColumns({"_raw": raw, "_room": room_total}).withColumn(
        grade,
        F.when((F.col("_raw") > F.col(total)) & (F.col("_raw") > TINY), F.col(grade) * F.col(total) / F.col("_raw"))
        .when(
            (F.col("_raw") < F.col(total)) & (F.col("_room") > TINY),
            F.col(grade) + (F.col(total) - F.col("_raw")) * room / F.col("_room"),
        )
        .otherwise(F.col(grade)),
    ).drop("_raw", "_room")


def grade_clips(
    pairs_: DataFrame, calibration: DataFrame, key: str = KEY, skill: str = "skill"
) -> tuple[DataFrame, DataFrame]:
    """(one row per clip with components and total, one row per clip and criterion)."""
    totals = with_scores(D.correction_distance(pairs_, [key], skill), calibration, skill)
    raw = with_scores(criterion_distances(pairs_, key, skill), calibration, skill, "distance", "_score")
    graded = raw.withColumn("grade", F.col("maximum") * F.col("_score") / 100.0).drop("_score")
    joined = graded.join(totals.select(key, "total_grade"), key)
    return totals, reconcile(joined, keys=[key])


# --- evidence ---------------------------------------------------------------------


def keypoint_evidence(
    pairs_: DataFrame, calibration: DataFrame, key: str = KEY, skill: str = "skill"
) -> DataFrame:
    """One advice row per clip and named joint: score, parts, worst phase, direction."""
    spark = pairs_.sparkSession
    terms = D.frame_terms(pairs_, [key, skill])
    names = F.broadcast(spec.joint_names(spark))
    full = D.keypoint_components(terms, [key, skill]).join(names, "joint")
    windows = spec.phase_windows(spark)
    in_phase = D.keypoint_components(
        D.expand_windows(terms, windows, skill), [key, skill, "ord", "phase"], F.col("frame") > F.col("start")
    ).join(names.select("joint"), "joint")
    phases = with_scores(in_phase, calibration, skill, name="phase_score")
    # at most four phases per clip and joint
    per_joint = phases.groupBy(key, "joint").agg(
        F.max(F.struct("correction_distance", -F.col("ord"), "phase", "ord")).alias("_worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "phase_score")))).alias("phase_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "correction_distance")))).alias("phase_distances"),
    )
    joints = F.array(*[F.lit(j) for j in spec.JOINT_NAMES])
    shift = pairs_.select(key, skill, "frame", "s", "t", "c", F.explode(joints).alias("joint")).selectExpr(
        key, skill, "frame", "joint", "c[joint] AS mask",
        *[f"(t[3*joint+{i}] - s[3*joint+{i}]) * c[joint] AS m{i}" for i in range(3)],
    )
    moved = D.expand_windows(shift, windows, skill).groupBy(key, "joint", "phase").agg(
        F.sum("mask").alias("mask"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(3)]
    )
    mean = lambda i: F.when(F.col("mask") > TINY, F.col(f"m{i}") / F.col("mask")).otherwise(0.0)
    vectors = moved.select(key, "joint", "phase", mean(0).alias("vx"), mean(1).alias("vy"), mean(2).alias("vz"))
    scored = with_scores(full, calibration, skill, name="score")
    picked = scored.join(per_joint.withColumn("worst_phase", F.col("_worst.phase")), [key, "joint"]).join(
        vectors.withColumnRenamed("phase", "worst_phase"), [key, "joint", "worst_phase"]
    )
    weight = F.get(spec.joint_weight_array(skill), F.col("joint"))
    return picked.select(
        key, skill, "joint", "keypoint", "score", "correction_distance", "position_distance",
        "angle_distance", "velocity_distance", "bone_length_distance",
        weight.alias("importance_weight"), "worst_phase",
        direction(F.col("vx"), F.col("vy"), F.col("vz")).alias("correction_direction"),
        "vx", "vy", "vz", "phase_scores", "phase_distances",
    )


def top_corrections(evidence: DataFrame, k: int = 5, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """The k joints to correct first: low score, then high weight, then joint order."""
    w = Window.partitionBy(*keys).orderBy(F.col("score"), F.desc("importance_weight"), F.col("joint"))
    return evidence.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= k)


def lowest_keypoints(evidence: DataFrame, k: int = 8, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """The k lowest keypoint scores; a missing score counts as 100."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("score", F.lit(100.0)), F.col("joint"))
    return evidence.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# --- cohorts ----------------------------------------------------------------------


def separation_auc(
    df: DataFrame, value: str, positive: Column, by: Sequence[str]
) -> DataFrame:
    """P(positive > negative) + P(equal)/2 per group from rank sums; null with one class."""
    marked = df.withColumn("_pos", positive.cast("int"))
    running = running_totals(marked, by, value)
    sides = marked.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("_pos").alias("_p"))
    ranks = running.join(sides, [*by, value]).withColumn(
        "_rank", F.col("before") + (F.col("n") + 1) / 2.0
    )
    sums = ranks.groupBy(*by).agg(
        F.sum(F.col("_rank") * F.col("_p")).alias("_r"),
        F.sum("_p").alias("_np"),
        F.sum(F.col("n") - F.col("_p")).alias("_nn"),
    )
    np_, nn = F.col("_np"), F.col("_nn")
    auc = F.when((np_ > 0) & (nn > 0), (F.col("_r") - np_ * (np_ + 1) / 2.0) / (np_ * nn))
    return sums.select(*by, auc.alias("auc"))


def cohort_summary(
    grades: DataFrame, by: Sequence[str] = ("skill",), split: str = "split"
) -> DataFrame:
    """Score and distance statistics per cohort and per evaluation split of a cohort.

    Overlap compares beginners with the reference experts: the test split, else the
    validation split, else all experts. The AUC uses test beginners when there are any.
    """
    by = list(by)
    expert = F.col("label") == "experts"
    has = lambda c: F.max(c.cast("int")) == 1
    have = grades.groupBy(*by).agg(
        F.coalesce(has(expert & (F.col(split) == "test")), F.lit(False)).alias("_xt"),
        F.coalesce(has(expert & (F.col(split) == "validation")), F.lit(False)).alias("_xv"),
        F.coalesce(has(~expert & (F.col(split) == "test")), F.lit(False)).alias("_bt"),
    )
    reference = expert & (
        F.when(F.col("_xt"), F.col(split) == "test").when(F.col("_xv"), F.col(split) == "validation").otherwise(True)
    )
    compared = ~expert & F.when(F.col("_bt"), F.col(split) == "test").otherwise(True)
    marked = grades.join(F.broadcast(have), by).withColumns({"_ref": reference, "_cmp": compared})
    limits = marked.where("_ref").groupBy(*by).agg(
        F.min("total_grade").alias("_min"), F.max("correction_distance").alias("_max")
    )
    auc = separation_auc(
        marked.where("_ref OR _cmp"), "correction_distance", ~expert, by
    ).withColumnRenamed("auc", "separation_auc")
    group = F.array(
        F.col("label"),
        F.when((F.col(split) == "validation"), F.concat("label", F.lit("_validation"))),
        F.when(expert & (F.col(split) == "test"), F.lit("experts_test")),
        F.when(F.col("_cmp"), F.lit("beginners_test")),
    )
    rows = marked.join(F.broadcast(limits), by, "left").withColumn(
        "group", F.explode(F.array_compact(group))
    )
    keys = [*by, "group"]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("total_grade").alias("mean"),
        F.min("total_grade").alias("min"),
        F.max("total_grade").alias("max"),
        F.avg("correction_distance").alias("correction_distance_mean"),
        F.avg((F.col("total_grade") >= F.col("_min")).cast("double")).alias("_overlap"),
        F.avg((F.col("correction_distance") <= F.col("_max")).cast("double")).alias("_close"),
    )
    medians = exact_percentiles(rows, keys, "total_grade", {"median": 0.5}).join(
        exact_percentiles(rows, keys, "correction_distance", {"correction_distance_median": 0.5}), keys
    )
    only = lambda c: F.when(F.col("group") == "beginners", F.col(c)).otherwise(0.0)
    return (
        base.join(medians, keys)
        .join(F.broadcast(auc), by, "left")
        .select(
            *keys, "count", "mean", "median", "min", "max", only("_overlap").alias("overlap"),
            "correction_distance_mean", "correction_distance_median",
            only("_close").alias("distance_overlap"), "separation_auc",
        )
    )


def score_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """New scores with the old ones of the same (filename, label) and the difference."""
    before = old.select("filename", "label", F.col("total_grade").alias("old_total_grade"))
    return (
        new.select("filename", "label", F.col("total_grade").alias("new_total_grade"))
        .join(before, ["filename", "label"], "left")
        .withColumn("score_delta", F.col("new_total_grade") - F.col("old_total_grade"))
    )


def single_grade(requests: DataFrame, grades: DataFrame) -> DataFrame:
    """Grade of each (filename, label) when there is exactly one, an error otherwise."""
    counted = grades.groupBy("filename", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.first("total_grade").alias("_g")
    )
    n = F.coalesce("_n", F.lit(0))
    return requests.join(counted, ["filename", "label"], "left").select(
        *requests.columns,
        F.when(n == 1, F.col("_g")).alias("score"),
        F.when(n == 1, "success").otherwise("error").alias("status"),
        F.when(n == 1, "").otherwise(F.concat(F.lit("expected one grade row, found "), n.cast("string"))).alias("error"),
    )


def preferred_grade(grades: DataFrame, order: str) -> DataFrame:
    """First row per filename, rows of beginners before all others."""
    w = Window.partitionBy("filename").orderBy(F.when(F.col("label") == "beginners", 0).otherwise(1), F.col(order))
    return grades.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


_SPLIT_ORDER = ("validation", "test", "training", "legacy_validation")


def evaluation_split(clips: DataFrame, splits: DataFrame) -> DataFrame:
    """Split of each clip by precedence; clips in no split belong to 'evaluation'.

    ``splits`` has (filename, label, split); 'legacy_validation' counts for experts only.
    """
    order = F.coalesce(*[F.when(F.col("split") == s, i) for i, s in enumerate(_SPLIT_ORDER)])
    usable = splits.where((F.col("split") != "legacy_validation") | (F.col("label") == "experts"))
    best = usable.groupBy("filename", "label").agg(F.min(F.struct(order.alias("o"), "split")).alias("_s"))
    name = F.when(F.col("_s.split") == "legacy_validation", "validation").otherwise(F.col("_s.split"))
    return clips.join(best, ["filename", "label"], "left").select(
        *clips.columns, F.coalesce(name, F.lit("evaluation")).alias("evaluation_split")
    )


# --- exports ----------------------------------------------------------------------


def foreign_skill(df: DataFrame, skill: str) -> DataFrame:
    """Rows that must not be in a table of one skill."""
    return df.where(~F.col("skill").eqNullSafe(F.lit(skill)))


def wide_grades(totals: DataFrame, criteria: DataFrame, key: str = KEY) -> DataFrame:
    """Totals with detail_{k}_desc/grade/distance columns; k = 1..6 known in advance."""
    cell = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = criteria.groupBy(key).agg(
        *[
            cell(k, c).alias(f"detail_{k + 1}_{name}")
            for k in range(6)
            for c, name in (("name", "desc"), ("grade", "grade"), ("distance", "distance"))
        ]
    )
    return totals.join(wide, key, "left")


def wide_keypoints(evidence: DataFrame, key: str = KEY) -> DataFrame:
    """keypoint_{name}_score/distance columns per clip."""
    cell = lambda n, c: F.max(F.when(F.col("keypoint") == n, F.col(c)))
    return evidence.groupBy(key).agg(
        *[
            cell(n, c).alias(f"keypoint_{n}_{suffix}")
            for n in spec.JOINT_NAMES.values()
            for c, suffix in (("score", "score"), ("correction_distance", "distance"))
        ]
    )


def compact_grades(grades: DataFrame) -> DataFrame:
    return grades.select(
        file_stem(F.col("filename")).alias("subject_name"),
        "filename",
        F.col("label").alias("group"),
        F.col("total_grade").alias("grade"),
        *[c for c in ("evaluation_split", "status", "model_path", "score_status") if c in grades.columns],
    )


def export_scores(grades: DataFrame) -> DataFrame:
    """Successful rows, renamed, with beginners shown as students."""
    ok = grades.where(F.col("status") == "success") if "status" in grades.columns else grades
    drop = [c for c in ("status", "error") if c in grades.columns]
    return ok.drop(*drop).withColumn(
        "label", F.when(F.col("label") == "beginners", "students").otherwise(F.col("label"))
    ).withColumnsRenamed({"label": "group", "total_grade": "total_score"})


def group_means(scores: DataFrame, columns: Sequence[str], by: Sequence[str] = ("group",)) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clip_count"), *[F.avg(c).alias(c) for c in columns]
    )


def inventory(clips: DataFrame) -> DataFrame:
    """Clips per skill and hand, with totals."""
    return clips.groupBy("skill").agg(
        F.sum((F.col("handedness") == "right").cast("int")).alias("right"),
        F.sum((F.col("handedness") == "left").cast("int")).alias("left"),
        F.count(F.lit(1)).alias("total"),
    )
