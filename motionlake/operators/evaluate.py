"""Evaluation of cohorts, corrections, candidate sources and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.columns import finite
from motionlake.functions.ordered import exact_percentiles, with_average_ranks
from motionlake.operators import matching as M
from motionlake.session import settle

KEY = "clip_id"


def expert_variability(bank: DataFrame, quantile: float = 0.95, by: str = "skill") -> DataFrame:
    """Nearest other expert of the same skill and hand: count, mean, quantile, max, error.

    A group with fewer than two measured experts keeps a row with its count and an error.
    """
    skills = bank.select(KEY, by).distinct()
    near = M.match_expert_euclidean(bank, bank, exclude_self=True).join(skills, KEY)
    base = near.groupBy(by).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("distance").alias("mean_nearest"),
        F.max("distance").alias("max_nearest"),
    )
    top = exact_percentiles(near, [by], "distance", {"p95_nearest": quantile})
    rows = skills.select(by).distinct().join(base.join(top, by), by, "left")
    count = F.coalesce("count", F.lit(0)).cast("bigint")
    enough = count >= 2
    measured = [F.when(enough, F.col(c)).alias(c) for c in ("mean_nearest", "p95_nearest", "max_nearest")]
    error = F.when(enough, "").otherwise("at least two experts are required to measure variability")
    return rows.select(by, count.alias("count"), *measured, error.alias("error"))


def _rank_sums() -> list[Column]:
    """Sums over the ranks ``_ra`` and ``_rb`` of rows that have both."""
    both = F.col("_ra").isNotNull() & F.col("_rb").isNotNull()
    x, y = F.when(both, F.col("_ra")), F.when(both, F.col("_rb"))
    products = {"_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}
    return [F.count(F.when(both, 1)).alias("_n"), *[F.sum(p).alias(name) for name, p in products.items()]]


def _rank_correlation() -> Column:
    n = F.col("_n")
    vx = F.col("_xx") - F.col("_x") * F.col("_x") / n
    vy = F.col("_yy") - F.col("_y") * F.col("_y") / n
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / n
    return F.when((n >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def _ranked(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Rows with the average ranks ``_ra`` and ``_rb`` of two values: two moves of the rows."""
    return with_average_ranks(with_average_ranks(df, by, a, "_ra"), by, b, "_rb", df)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation per group; null below three rows or with a constant side."""
    by = list(by)
    sums = _ranked(df.select(*by, a, b), a, b, by).groupBy(*by).agg(*_rank_sums())
    return sums.where("_n > 0").select(*by, _rank_correlation().alias("spearman"))


# --- source comparison --------------------------------------------------------------


def with_status(
    manifest: DataFrame, candidates: DataFrame, on: Sequence[str], names: Sequence[object]
) -> DataFrame:
    """Every manifest row once per candidate name; rows a candidate lacks are 'missing'."""
    wanted = manifest.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in names])))
    found = candidates.withColumn("_found", F.lit(True))
    return wanted.join(found, [*on, "candidate"], "left").withColumn(
        "status", F.when(F.col("_found"), "success").otherwise("missing")
    ).drop("_found")


def interval_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap of two inclusive integer intervals over their span."""
    inter = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)
    span = F.greatest(end_a, end_b) - F.least(start_a, start_b) + 1
    return inter / F.greatest(span, F.lit(1))


def anchor_agreement(own: Column, reference: Column, fps: Column) -> dict[str, Column]:
    """Anchor error in frames and milliseconds and the share within 100 ms."""
    gaps = F.zip_with(own, reference, lambda a, b: F.abs(a - b))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)
    mean = total / F.size(gaps)
    rate = F.when(fps > 0, fps).otherwise(30.0)
    limit = F.greatest(F.lit(1.0), F.rint(rate * 0.1))
    return {
        "checkpoint_mae_frames": mean,
        "checkpoint_mae_milliseconds": mean * 1000.0 / rate,
        "checkpoint_recall_100ms": F.size(F.filter(gaps, lambda g: g <= limit)) / F.size(gaps),
    }


def pose_agreement(pairs_: DataFrame, keys: Sequence[str] = (KEY,), limit: float = 0.2) -> DataFrame:
    """Mean joint distance, share of joints within ``limit`` and mean angle error in degrees.

    Null where nothing was observed.
    """
    from motionlake.operators.distance import ANGLE, JOINT, frame_terms

    terms = frame_terms(pairs_, keys)
    err, mask = F.col("err"), F.col("mask")
    joint, angle = F.col("kind") == JOINT, F.col("kind") == ANGLE

    def mean(kind: Column, factor: float = 1.0) -> Column:
        den = F.sum(F.when(kind, mask))
        return F.when(den > 1e-8, F.sum(F.when(kind, err * factor * mask)) / den)

    seen = joint & (mask > 0.05)
    return terms.groupBy(*keys).agg(
        mean(joint).alias("pose_distance_2d"),
        F.avg(F.when(seen, (err <= limit).cast("double"))).alias("pck_02"),
        mean(angle, 180.0).alias("joint_angle_mae_degrees"),
    )


def metric_summary(
    details: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("candidate",), part: str = "skill"
) -> DataFrame:
    """Mean and exact p95 of every metric per part and over all, in long form.

    NaN, infinite and null values are left out of a metric, not out of the counts. Details
    are read once and compressed to counts per (group, metric, value); the rows of "all"
    and the statistics come from the counts. Rows without a good value count as null ones.
    """
    keys = [*by, part]
    success = F.col("status") == "success"
    values = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.when(success, finite(F.col(m).cast("double"))).alias("v"))
            for m in metrics
        ]
    )
    counted = (
        details.select(*keys, success.alias("_ok"), F.inline(values))
        .groupBy(*keys, "metric", "v")
        .agg(F.sum(F.col("_ok").cast("bigint")).alias("_good"), F.sum((~F.col("_ok")).cast("bigint")).alias("_bad"))
        .withColumn(part, F.explode(F.array(F.col(part), F.lit("all"))))
    )
    totals = counted.groupBy(*keys, "metric").agg(
        F.sum("_good").alias("samples"),
        F.sum("_bad").alias("failures"),
        (F.sum(F.col("v") * F.col("_good")) / F.sum(F.when(F.col("v").isNotNull(), F.col("_good")))).alias("mean"),
    )
    p95 = exact_percentiles(counted, [*keys, "metric"], "v", {"p95": 0.95}, F.col("_good"))
    return totals.join(p95, [*keys, "metric"], "left")


def criterion_errors(own: Column, reference: Column) -> Column:
    """Absolute differences of two equally long grade arrays."""
    return F.zip_with(own, reference, lambda a, b: F.abs(a - b))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def grading_summary(rows: DataFrame, by: Sequence[str] = ("candidate",), part: str = "skill") -> DataFrame:
    """Agreement of candidate grades with the oracle per part and over all.

    Needs label, split, total_score, oracle_total_score and criterion_score_mae.
    Calibration rows only feed the calibration mean. The rows are written out once, because
    means and ranks read them; one pair of ranks gives both the correlation and the AUC.
    """
    keys = [*by, part]
    score, oracle = F.col("total_score"), F.col("oracle_total_score")
    columns = [*keys, "label", "split", "total_score", "oracle_total_score", "criterion_score_mae"]
    both = settle(rows.select(*columns)).withColumn(part, F.explode(F.array(F.col(part), F.lit("all"))))
    tested = F.col("split") != "calibration"
    in_test = lambda c: F.when(tested, c)
    of = lambda label: F.when(tested & (F.col("label") == label), score)
    base = both.groupBy(*keys).agg(
        F.count(in_test(F.lit(1))).alias("test_samples"),
        F.sum(in_test((F.col("label") == "experts").cast("int"))).alias("test_experts"),
        F.sum(in_test((F.col("label") == "beginners").cast("int"))).alias("test_beginners"),
        F.avg(in_test(F.abs(score - oracle))).alias("total_score_mae"),
        F.avg(in_test(F.col("criterion_score_mae"))).alias("criterion_score_mae"),
        F.avg(of("experts")).alias("expert_score_mean"),
        F.avg(of("beginners")).alias("beginner_score_mean"),
        F.avg(F.when(~tested, score)).alias("calibration_beginner_score_mean"),
    ).where("test_samples > 0")
    values = both.where(tested).select(*keys, "total_score", "oracle_total_score", (F.col("label") == "beginners").alias("_pos"))
    # Lower scores come first in the AUC: ranks turn round, except those of NaN, which stays last.
    seen, pos, nan = F.col("_ra").isNotNull(), F.col("_pos"), F.isnan("total_score")
    sums = _ranked(values, "total_score", "oracle_total_score", keys).groupBy(*keys).agg(
        *_rank_sums(),
        F.count(F.when(seen & pos, 1)).alias("_np"),
        F.count(F.when(seen & ~pos, 1)).alias("_nn"),
        F.count(F.when(nan, 1)).alias("_nan"),
        F.count(F.when(pos & seen & ~nan, 1)).alias("_turned"),
        F.sum(F.when(pos, F.when(nan, F.col("_ra")).otherwise(-F.col("_ra")))).alias("_r"),
    )
    np_, nn = F.col("_np"), F.col("_nn")
    lowered = F.col("_turned") * (np_ + nn - F.col("_nan") + 1) + F.col("_r")
    auc = F.when((np_ > 0) & (nn > 0), (lowered - np_ * (np_ + 1) / 2.0) / (np_ * nn))
    ranks = sums.select(*keys, F.when(F.col("_n") > 0, _rank_correlation()).alias("score_spearman"), auc.alias("expert_beginner_auc"))
    return base.join(ranks, keys, "left")


def expected_counts(manifest: DataFrame, calibration_keys: DataFrame, on: Sequence[str], part: str = "skill") -> DataFrame:
    """Clips an evaluation should contain: all experts and the beginners not used to calibrate."""
    usable = manifest.join(calibration_keys.select(*on).withColumn("_cal", F.lit(True)), list(on), "left").where(
        (F.col("label") == "experts") | F.col("_cal").isNull()
    )
    both = usable.withColumn(part, F.explode(F.array(F.col(part), F.lit("all"))))
    return both.groupBy(part).agg(F.count(F.lit(1)).alias("expected_evaluation_samples"))


# --- corrections --------------------------------------------------------------------


def correction_summary(rows: DataFrame, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """One summary per group from per-student correction rows.

    Ratios are averaged per student; the bone change is the maximum of the per-row p95.
    """
    near, before = F.col("corrected_nearest_expert_distance"), F.col("input_nearest_expert_distance")
    tiny = F.lit(1e-8)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(before).alias("input_nearest_expert_distance"),
        F.avg(near).alias("corrected_nearest_expert_distance"),
        F.avg("corrected_nearest_unseen_expert_distance").alias("corrected_nearest_unseen_expert_distance"),
        F.avg(near / F.greatest(before, tiny)).alias("nearest_distance_ratio"),
        share(near < before).alias("improved_fraction"),
        share(near <= threshold).alias("within_expert_range_fraction"),
        F.avg("corrected_reference_target_distance").alias("mean_reference_target_distance"),
        F.max("corrected_reference_target_distance").alias("max_reference_target_distance"),
        F.avg("input_mean_expert_distance").alias("input_mean_expert_distance"),
        F.avg("corrected_mean_expert_distance").alias("corrected_mean_expert_distance"),
        F.avg(
            F.col("corrected_mean_expert_distance") / F.greatest(F.col("input_mean_expert_distance"), tiny)
        ).alias("mean_expert_distance_ratio"),
        F.max("max_joint_correction").alias("max_joint_correction"),
        F.avg("mean_correction_acceleration").alias("mean_correction_acceleration"),
        F.avg("reference_correction_acceleration").alias("mean_reference_correction_acceleration"),
        F.avg("correction_acceleration_ratio").alias("mean_correction_acceleration_ratio"),
        F.max("p95_relative_bone_change").alias("p95_relative_bone_change"),
    )


GATE = {
    "improved_fraction": 1.0,
    "within_expert_range_fraction": 1.0,
    "max_reference_target_distance": 0.1,
    "max_correction": 0.8,
    "acceleration_ratio": 1.1,
    "bone_change": 1e-3,
}


def acceptance_gate(metrics: DataFrame, limits: Mapping[str, float] = GATE, order: str = "epoch", by: Sequence[str] = ()) -> DataFrame:
    """Mark accepted rows and the best one: smallest corrected distance, earliest on ties.

    ``expert_p95`` is the allowed nearest distance of each row.
    """
    ok = (
        (F.col("improved_fraction") >= limits["improved_fraction"])
        & (F.col("within_expert_range_fraction") >= limits["within_expert_range_fraction"])
        & (F.col("corrected_nearest_expert_distance") <= F.col("expert_p95"))
        & (F.col("max_reference_target_distance") <= limits["max_reference_target_distance"])
        & (F.col("max_joint_correction") <= limits["max_correction"] * 1.5)
        & (F.col("mean_correction_acceleration_ratio") <= limits["acceleration_ratio"])
        & (F.col("p95_relative_bone_change") < limits["bone_change"])
    )
    marked = metrics.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    best = marked.where("accepted").groupBy(*by).agg(
        F.min(F.struct("corrected_nearest_expert_distance", order)).alias("_b")
    )
    best = best.select(*by, F.col(f"_b.{order}").alias(order), F.lit(True).alias("_best"))
    return marked.join(F.broadcast(best), [*by, order], "left").withColumn(
        "best", F.coalesce("_best", F.lit(False))
    ).drop("_best")


def safety_violations(summary: DataFrame, limits: Mapping[str, float] = GATE) -> DataFrame:
    """Summaries an accepted model must not produce over all students."""
    return summary.where(
        (F.col("max_joint_correction") > limits["max_correction"] * 1.5)
        | (F.col("mean_correction_acceleration_ratio") > limits["acceleration_ratio"])
        | (F.col("p95_relative_bone_change") >= limits["bone_change"])
        | (F.col("max_reference_target_distance") > limits["max_reference_target_distance"])
    )


def runtime_stats(runs: DataFrame, by: Sequence[str], seconds: str = "seconds", frames: str = "frames") -> DataFrame:
    """Mean and p95 latency per clip and frames per second over all clips."""
    by = list(by)
    base = runs.groupBy(*by).agg(
        F.avg(seconds).alias("mean_seconds"), (F.sum(frames) / F.sum(seconds)).alias("fps")
    )
    return base.join(exact_percentiles(runs, by, seconds, {"p95_seconds": 0.95}), by)
