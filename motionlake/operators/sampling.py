"""Sorting, selection, splits and deterministic sampling.

Positions inside a group are resolved in two levels (order block, then row), so a group
that holds most of the rows is not sorted in one task. Limits of a few rows per group
use ``row_number() <= k``, which Spark applies per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.columns import natural_key, seeded_normal, seeded_order, seeded_unit
from motionlake.functions.ordered import number_rows, sampled_block

KEY = "clip_id"


def first_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def extremes(df: DataFrame, k: int, value: str, order: str, by: Sequence[str], largest: bool = False) -> DataFrame:
    """k smallest (or largest) rows per group; earlier rows win ties."""
    v = F.col(value)
    return first_k(df, k, by, [v.desc() if largest else v.asc(), F.col(order)])


def lowest(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    if by:
        return first_k(df, 1, by, [F.col(value), F.col(order)]).drop("place")
    return df.orderBy(value, order).limit(1)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = KEY) -> DataFrame:
    """n repeatable pseudo-random rows (top-n by hash, not a full sort)."""
    return df.withColumn("_h", seeded_order(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def hash_positions(
    df: DataFrame, by: Sequence[str], seed: int, key: str = KEY, name: str = "place", total: str | None = None
) -> DataFrame:
    """Shuffled 0-based position per group; hash prefixes are evenly filled blocks."""
    keyed = df.withColumn("_key", seeded_order(F.col(key), seed))
    block = F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")
    return number_rows(keyed, by, ["_key", key], block, name, total).drop("_key")


def natural_positions(
    df: DataFrame, by: Sequence[str], order: str, name: str = "place", total: str | None = None
) -> DataFrame:
    """0-based position per group in natural order of a text or number column."""
    keyed = df.withColumn("_key", natural_key(F.col(order).cast("string")))
    return number_rows(keyed, by, ["_key", order], sampled_block(keyed, "_key"), name, total).drop("_key")


def evenly_spaced(df: DataFrame, k: Column, by: Sequence[str], order: str = KEY) -> DataFrame:
    """Rows at positions rint(linspace(0, n-1, k)) of the natural order, per group.

    ``k`` may depend on the group. A row that several positions hit appears once here.
    """
    placed = natural_positions(df.withColumn("_k", k), by, order, total="_n")
    # position p is wanted when some i in 0..k-1 has rint(i (n-1) / (k-1)) = p; only the
    # two i around p (k-1) / (n-1) can
    steps, span = F.greatest(F.col("_k") - 1, F.lit(1)), F.greatest(F.col("_n") - 1, F.lit(1))
    guess = F.floor(F.col("place") * steps / span)
    hit = lambda i: (i <= F.col("_k") - 1) & (F.rint(i * (F.col("_n") - 1) / steps) == F.col("place"))
    return placed.where(hit(guess) | hit(guess + 1)).drop("_k", "_n")


def split(
    df: DataFrame,
    seed: int,
    test: float = 0.2,
    validation: float = 0.1,
    stratify: Sequence[str] = (),
    key: str = KEY,
    group: Sequence[str] = (),
) -> DataFrame:
    """Train/validation/test by shuffled position; every stratum gets all three.

    Counts are max(1, round-half-even(share x n)). A group without strata needs 10
    rows, a stratum 3; smaller ones come back with split 'error'.
    """
    by = [*group, *stratify] or ["_all"]
    rows = df if by != ["_all"] else df.withColumn("_all", F.lit(1))
    placed = hash_positions(rows, by, seed, key, "place", "_n")
    count = lambda share: F.greatest(F.lit(1.0), F.rint(F.col("_n") * share))
    needed = 3 if stratify else 10
    name = (
        F.when(F.col("_n") < needed, "error")
        .when(F.col("place") < count(test), "test")
        .when(F.col("place") < count(test) + count(validation), "validation")
        .otherwise("training")
    )
    return placed.withColumn("split", name).drop("_n", "place", "_all")


def assign_roles(experts: DataFrame, by: Sequence[str], order: str = KEY) -> DataFrame:
    """Every third expert is held out for evaluation, the others are references."""
    placed = natural_positions(experts, by, order)
    return placed.withColumn("role", F.when(F.col("place") % 3 != 2, "reference").otherwise("evaluation"))


def build_manifest(
    clips: DataFrame, k_by_group: Mapping[str, int], required: DataFrame | None = None,
    media: DataFrame | None = None, by: Sequence[str] = ("skill", "label"), subject: str = "subject",
) -> DataFrame:
    """Evenly chosen clips per group plus required ones, with role and media path.

    ``media`` has (skill, label, subject, path, exact); a subject resolves to its exact
    file or to a unique alternative, otherwise the row carries an error.
    """
    by = list(by)
    count = F.coalesce(*[F.when(F.col("label") == g, k) for g, k in k_by_group.items()])
    chosen = evenly_spaced(clips, count, by, subject).drop("place")
    if required is not None:
        extra = clips.join(required.select(*by, subject).distinct(), [*by, subject], "left_semi")
        chosen = chosen.unionByName(extra).dropDuplicates([*by, subject])
    placed = natural_positions(chosen, by, subject)
    role = F.when((F.col("label") == "experts") & (F.col("place") % 3 != 2), "reference").otherwise("evaluation")
    rows = placed.withColumn("role", role)
    if media is None:
        return rows
    best = media.groupBy(*by, subject).agg(
        F.min(F.when(F.col("exact"), F.col("path"))).alias("_exact"),
        F.count(F.lit(1)).alias("_n"),
        F.min("path").alias("_any"),
    )
    path = F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_any")))
    return rows.join(best, [*by, subject], "left").withColumns(
        {"path": path, "error": F.when(path.isNull(), "no unique media file").otherwise("")}
    ).drop("_exact", "_n", "_any")


def page(df: DataFrame, order: Sequence[str], offset: int, size: int = 200) -> DataFrame:
    """One page; the offset is clamped to the last row and floored to a page start."""
    total = df.count()
    start = max(0, min(offset, max(0, total - 1))) // size * size
    return df.orderBy(*order).offset(start).limit(size)


def augment_clips(frames: DataFrame, seed: int, kind: str = "pair", key: str = KEY) -> DataFrame:
    """Repeatable pose and timing corruption of 64-frame clips (frames layout).

    Per clip: a noise level, a masking rate, a shift of -2..2 frames with edge hold and
    one offset per limb joint. All draws come from hashes of clip, frame and joint, so
    they do not depend on partitioning.
    """
    noise0, noise1, mask0, mask1 = {"pair": (0.02, 0.06, 0.02, 0.08), "sequence": (0.03, 0.12, 0.04, 0.12)}[kind]
    clip = F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))
    sigma = noise0 + noise1 * seeded_unit(clip, "sigma")
    rate = mask0 + mask1 * seeded_unit(clip, "mask")
    shift = (F.floor(seeded_unit(clip, "shift") * 5) - 2).cast("int")
    last = frames.groupBy(key).agg(F.max("frame").alias("_last"))
    drawn = frames.join(last, key).withColumns({"_sigma": sigma, "_rate": rate, "_shift": shift})
    # Output frame f shows source frame f - shift, held at the edges: a source frame is
    # shown once, and the first and last one also fill what the shift leaves open.
    moved = F.col("frame") + F.col("_shift")
    low = F.greatest(F.lit(0), F.when(F.col("frame") == 0, F.lit(0)).otherwise(moved))
    high = F.least(F.col("_last"), F.when(F.col("frame") == F.col("_last"), F.col("_last")).otherwise(moved))
    span = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
    shown = drawn.withColumn("_src", F.col("frame")).withColumn("frame", F.explode(span))
    joints = F.array(*[F.lit(j) for j in range(17)])
    keep = [c for c in frames.columns if c not in ("p", "c", "frame")]
    long = shown.select(*keep, "frame", "_src", "_sigma", "_rate", "p", "c", F.explode(joints).alias("joint"))
    at = F.concat(clip, F.lit("/"), F.col("_src").cast("string"), F.lit("/"), F.col("joint").cast("string"))
    limb = F.concat(clip, F.lit("/limb/"), F.col("joint").cast("string"))
    hidden = seeded_unit(at, "drop") < F.col("_rate")
    limb_joint = F.col("joint").isin(7, 8, 9, 10, 13, 14, 15, 16)
    columns = {}
    for i, a in enumerate(("x", "y", "z")):
        noisy = F.get("p", 3 * F.col("joint") + i) + seeded_normal(at, a) * F.col("_sigma")
        offset = F.when(limb_joint, seeded_normal(limb, a) * F.col("_sigma") * 0.75).otherwise(0.0)
        columns[a] = F.when(hidden, 0.0).otherwise(noisy) + offset
    columns["conf"] = F.when(hidden, 0.0).otherwise(F.get("c", F.col("joint")))
    return long.withColumns(columns).select(*keep, "frame", "joint", "x", "y", "z", "conf")
