"""Bone adaptation, expert matching and correction.

Students and experts of one (skill, handedness, clip length) meet as *blocks*: a row holds
up to BLOCK students or CHUNK experts as flat arrays, so what crosses into Python per
student falls by the block size, and a kernel returns one best expert per student. The
expert table is broadcast while its measured size is small, else the frames of a group
move once, to the cells of a grid where they are packed and meet. A group's part of the
cells follows its share of the pairs, so one hot group is spread over many tasks and the
copies follow the cores, however large either side is. Every expert is compared either way,
and clips that cannot be compared come back as error rows (:func:`match_errors`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionlake import spec
from motionlake.functions import kernels
from motionlake.operators import timewarp
from motionlake.operators.distance import pairs
from motionlake.session import settle, ship_package

KEY = "clip_id"
CHUNK = 32
BLOCK = 32
BROADCAST_BYTES = 64 << 20
#: Copies of either side at most when blocks and chunks meet in a grid.
MAX_SIDE = 32
#: Cells of all groups' grids, and the partitions they are hashed to.
CELLS_PER_CORE = 2
PARTITIONS_PER_CELL = 16
MAX_PARTITIONS = 4096
#: Parts a popular expert's frames are dealt into when students join their expert.
SPREAD = 16
GROUP = ("skill", "handedness")


def _stack(column: pd.Series) -> np.ndarray:
    """Arrow list<list<double>> or list<double> column -> dense float array."""
    return np.stack([np.stack(v) if v.dtype == object else v for v in column])


def adapt_bone_lengths(
    pairs_: DataFrame, iterations: int = 20, target: str = "t", source: str = "s"
) -> DataFrame:
    """Give the target pose of every frame the bone lengths of its source pose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = _stack(batch[source]).reshape(-1, spec.JOINTS, 3)
                t = _stack(batch[target]).reshape(-1, spec.JOINTS, 3)
                moved = kernels.relax_bones(s, t, iterations).reshape(len(batch), -1)
                yield batch.assign(**{target: list(moved)})

    ship_package(pairs_.sparkSession)
    return pairs_.mapInPandas(run, pairs_.schema)


def clip_rows(frames: DataFrame, keep: Sequence[str] = GROUP, key: str = KEY) -> DataFrame:
    """One row per aligned clip, whatever its length: flat coordinates and confidences."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", "p", "c")))
    return (
        frames.groupBy(key, *keep)
        .agg(ordered.alias("_f"))
        .select(
            key,
            *keep,
            F.flatten(F.transform("_f", lambda f: f["p"])).alias("seq"),
            F.flatten(F.transform("_f", lambda f: f["c"])).alias("conf"),
            F.size("_f").alias("frames"),
        )
    )


def group_sizes(students: DataFrame, bank: DataFrame, group: Sequence[str]) -> DataFrame:
    """Clips of either side of every group that has both: (group, students, experts)."""
    count = lambda t, name: t.groupBy(*group).agg(F.count_distinct(KEY).alias(name))
    return count(students, "students").join(count(bank, "experts"), list(group))


def parted(frames: DataFrame, sizes: DataFrame, count: str, size: int, group: Sequence[str], key: str = KEY) -> DataFrame:
    """Frames with the pack ``_part`` of their clip: packs hold about ``size`` clips of a group, by hash."""
    parts = F.ceil(F.col(count) / F.lit(size))
    known = frames.join(F.broadcast(sizes.select(*group, count)), list(group))
    return known.select(key, *group, "frame", "p", "c", F.pmod(F.xxhash64(key), parts).alias("_part"))


def packed(frames: DataFrame, group: Sequence[str], prefix: str, key: str = KEY) -> DataFrame:
    """Clips of a frame table packed to rows by ``_part``; a row holds clips of one group and length."""
    entry = F.struct(F.col(key).alias("id"), "seq", "conf")
    return (
        clip_rows(frames, [*group, "_part"], key)
        .groupBy(*group, "frames", "_part")
        .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
        .select(
            *group,
            "frames",
            "_part",
            F.transform("_e", lambda e: e["id"]).alias(f"{prefix}_ids"),
            F.flatten(F.transform("_e", lambda e: e["seq"])).alias(f"{prefix}_seq"),
            F.flatten(F.transform("_e", lambda e: e["conf"])).alias(f"{prefix}_conf"),
        )
    )


def bank_size(bank: DataFrame) -> tuple[int, int]:
    """Clips of a bank and the bytes of their coordinates and confidences, whatever their length."""
    row = bank.agg(F.count_distinct(KEY).alias("n"), F.sum((F.size("p") + F.size("c")).cast("bigint") * 8).alias("bytes")).first()
    return row.n, row.bytes or 0


def grid_cells(spark: SparkSession) -> int:
    """Cells of all grids together, about: they follow the cores, not the clips."""
    return CELLS_PER_CORE * spark.sparkContext.defaultParallelism


def grid_side(spark: SparkSession) -> int:
    """Side of the square grid that one group would have alone."""
    return min(MAX_SIDE, math.ceil(math.sqrt(grid_cells(spark))))


def grid_sides(sizes: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Rows and columns of every group's grid: (group, _rows, _cols).

    A group gets its share of the cells by its pairs of clips. Students are copied once per
    column and experts once per row, so the smaller side gets the more copies.
    """
    pairs = F.col("students") * F.col("experts")
    total = sizes.agg(F.sum(pairs)).first()[0] or 1
    cells = F.ceil(pairs / F.lit(total) * grid_cells(sizes.sparkSession))
    cols = F.greatest(F.ceil(F.sqrt(cells * F.col("experts") / F.col("students"))), F.ceil(cells / F.lit(MAX_SIDE)))
    most = lambda n, size: F.least(F.ceil(F.col(n) / F.lit(size)), F.lit(MAX_SIDE).cast("bigint"))
    return sizes.withColumn("_cols", F.least(cols, most("experts", CHUNK))).select(
        *group, F.least(F.ceil(cells / F.col("_cols")), most("students", BLOCK)).alias("_rows"), "_cols"
    )


def in_cells(rows: DataFrame, own: str, other: str, sides: DataFrame, spread: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Rows in the cells (_row, _col) of their group's grid: ``own`` follows the pack, ``other`` takes every value."""
    line = F.pmod("_part", F.col(f"{own}s")).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}s").cast("int") - 1))
    dealt = rows.join(F.broadcast(sides), list(group)).withColumn(own, line).withColumn(other, copies)
    return dealt.drop("_rows", "_cols").repartition(spread, *group, "_row", "_col")


def join_blocks(
    blocks: DataFrame,
    chunks: DataFrame,
    bank_bytes: int,
    spread: int,
    group: Sequence[str] = GROUP,
    sides: DataFrame | None = None,
    pack: Callable[[DataFrame, Sequence[str], str], DataFrame] = lambda rows, group, prefix: rows,
) -> DataFrame:
    """Student blocks x the expert chunks of their group; broadcast only below a measured size.

    Above it both meet in the cells of the grid ``sides`` (a square if not given), in ``spread``
    partitions: the kernel is bound by CPU, so their bytes say little. ``pack`` turns what a
    cell got into its blocks or chunks, so that rows move once.
    """
    if bank_bytes <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(chunks.drop("_part")), [*group, "frames"]).drop("_part")
    if sides is None:
        side = F.lit(grid_side(blocks.sparkSession))
        sides = blocks.select(*group).distinct().withColumn("_rows", side).withColumn("_cols", side)
    keys = [*group, "_row", "_col"]
    dealt = pack(in_cells(blocks, "_row", "_col", sides, spread, group), keys, "s").drop("_part")
    held = pack(in_cells(chunks, "_col", "_row", sides, spread, group), keys, "e").drop("_part")
    # the lengths are compared beside the join keys: as one of them they would move the rows again
    met = dealt.join(held.withColumnRenamed("frames", "_frames"), keys)
    return met.where(F.col("frames") - F.col("_frames") == 0).drop("_frames", "_row", "_col")


#: Distances of one student clip (17, 3, 1, T) to experts (17, 3, E, T) under masks (17, E, T).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, str], np.ndarray]


def _adapted_kernel(iterations: int, transition: bool = True) -> Kernel:
    def score(source: np.ndarray, experts: np.ndarray, mask: np.ndarray, skill: str) -> np.ndarray:
        moved = kernels.relax_to(source, experts, iterations) if iterations else experts
        return kernels.correction_distances(source, moved, mask, skill, transition)

    return score


def _euclidean_kernel(source: np.ndarray, experts: np.ndarray, mask: np.ndarray, skill: str) -> np.ndarray:
    return kernels.euclidean_distances(source, experts, mask)


def _clips_of(row: dict, side: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, coordinates (17, 3, N, T) and confidences (17, N, T) of the clips of a packed row."""
    ids = row[f"{side}_ids"].as_py()
    numbers = lambda name: row[f"{side}_{name}"].values.to_numpy(zero_copy_only=False)
    shape = (len(ids), row["frames"].as_py(), spec.JOINTS)
    return ids, kernels.joints_first(numbers("seq").reshape(*shape, 3)), kernels.joints_first(numbers("conf").reshape(shape))


def nearest_expert(
    students: DataFrame,
    bank: DataFrame,
    kernel: Kernel,
    exclude_self: bool = False,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Best expert per student: (clip_id, expert_id, distance, mean_distance, experts).

    Both inputs are aligned frame tables. The lowest expert id wins ties. A student
    without any comparable expert is absent here and a row of :func:`match_errors`.
    ``group`` must name ``skill``, whose weights the kernel uses.
    """
    if "skill" not in group:
        raise ValueError("experts are matched within a skill: name it in group")
    _, bank_bytes = bank_size(bank)
    session = students.sparkSession
    sizes = settle(group_sizes(students, bank, group))
    blocks = parted(students, sizes, "students", BLOCK, group)
    chunks = parted(bank, sizes, "experts", CHUNK, group)
    # the kernel is bound by CPU, not bytes: keep small inputs on all cores
    spread = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    if bank_bytes <= BROADCAST_BYTES:
        blocks = packed(blocks, group, "s")
        if session.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true":
            blocks = blocks.repartition(spread)
        rows = join_blocks(blocks, packed(chunks, group, "e"), bank_bytes, spread, group)
    else:
        # many partitions for few cells: two of them seldom meet in one task
        spread = max(spread, min(MAX_PARTITIONS, PARTITIONS_PER_CELL * grid_cells(session)))
        rows = join_blocks(blocks, chunks, bank_bytes, spread, group, grid_sides(sizes, group), packed)
    id_type = students.schema[KEY].dataType
    schema = T.StructType(
        [
            T.StructField(KEY, id_type),
            T.StructField("expert_id", id_type),
            T.StructField("distance", T.DoubleType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("experts", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            id_kind = batch.schema.field("s_ids").type.value_type
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                ids, own, own_conf = _clips_of(row, "s")
                expert_ids, seq, conf = _clips_of(row, "e")
                skill = row["skill"].as_py()
                for i, clip in enumerate(ids):
                    use = [k for k, e in enumerate(expert_ids) if not (exclude_self and e == clip)]
                    if not use:
                        continue
                    found = kernel(own[:, :, i : i + 1], seq, conf * own_conf[:, i : i + 1], skill)[use]
                    best = int(np.argmin(found))
                    out.append((clip, expert_ids[use[best]], float(found[best]), float(found.sum()), len(use)))
            kinds = [id_kind, id_kind, pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], names=schema.names)

    # rows carry blocks of clips; Spark bounds an Arrow batch by its bytes
    ship_package(session)
    scored = rows.mapInArrow(run, schema)
    return scored.groupBy(KEY).agg(
        F.min(F.struct("distance", "expert_id")).alias("_best"),
        (F.sum("total") / F.sum("experts")).alias("mean_distance"),
        F.sum("experts").alias("experts"),
    ).select(
        KEY,
        F.col("_best.expert_id").alias("expert_id"),
        F.col("_best.distance").alias("distance"),
        "mean_distance",
        "experts",
    )


def without_expert(students: DataFrame, bank: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Students no expert of the same group exists for; never matched across groups."""
    clips = students.select(KEY, *group).distinct()
    return clips.join(bank.select(*group).distinct(), list(group), "left_anti").select(
        KEY, F.lit("no same-handed expert is available").alias("error")
    )


def match_errors(
    students: DataFrame, bank: DataFrame, exclude_self: bool = False, group: Sequence[str] = GROUP
) -> DataFrame:
    """(clip_id, error) of every student that matching cannot compare with any expert.

    Either its group has no (other) expert, or none with as many frames. Together with the
    rows of :func:`nearest_expert` this covers every student.
    """
    lengths = lambda t: t.groupBy(KEY, *group).agg(F.count(F.lit(1)).alias("frames"))
    own, experts = lengths(students), lengths(bank)
    by_group = experts.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    by_length = experts.groupBy(*group, "frames").agg(F.count(F.lit(1)).alias("_same"))
    rows = own.join(by_group, list(group), "left").join(by_length, [*group, "frames"], "left")
    if exclude_self:
        me = experts.select(KEY, *group, F.lit(1).alias("_me"))
        rows = rows.join(me, [KEY, *group], "left")
    else:
        rows = rows.withColumn("_me", F.lit(0))
    mine = F.coalesce("_me", F.lit(0))
    error = F.when(F.coalesce("_all", F.lit(0)) - mine <= 0, "no same-handed expert is available").when(
        F.coalesce("_same", F.lit(0)) - mine <= 0,
        F.concat(F.lit("no expert clip has "), F.col("frames").cast("string"), F.lit(" frames")),
    )
    return rows.select(KEY, error.alias("error")).where("error IS NOT NULL")


def match_expert_euclidean(
    students: DataFrame, bank: DataFrame, exclude_self: bool = False, group: Sequence[str] = GROUP
) -> DataFrame:
    return nearest_expert(students, bank, _euclidean_kernel, exclude_self, group)


def match_expert(
    students: DataFrame,
    bank: DataFrame,
    iterations: int = 20,
    exclude_self: bool = False,
    group: Sequence[str] = GROUP,
    transition: bool = True,
) -> DataFrame:
    """Nearest expert by correction distance, every expert adapted to the student first.

    Without ``transition`` the joint terms alone select.
    """
    return nearest_expert(students, bank, _adapted_kernel(iterations, transition), exclude_self, group)


def with_expert(students: DataFrame, bank: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs (s = student, t = matched expert, c = product of confidences) per frame.

    Popular experts are spread by joining matches to students first and then to the
    bank, which is broadcast below the size limit and salted above it.
    """
    experts = bank.select(F.col(KEY).alias("expert_id"), "frame", F.col("p").alias("t"), F.col("c").alias("_ec"))
    chosen = students.withColumnRenamed("p", "s").join(matches.select(KEY, "expert_id"), KEY)
    _, bank_bytes = bank_size(bank)
    if bank_bytes <= BROADCAST_BYTES:
        joined = chosen.join(F.broadcast(experts), ["expert_id", "frame"])
    else:
        salted = experts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = chosen.withColumn("_salt", F.pmod(F.xxhash64(KEY), F.lit(SPREAD)).cast("int")).join(
            salted, ["expert_id", "frame", "_salt"]
        ).drop("_salt")
    return joined.withColumn("own_c", F.col("c")).withColumn(
        "c", F.zip_with("c", "_ec", lambda a, b: a * b)
    ).withColumnRenamed("_ec", "expert_c")


def _mix(a: str, b: str, share: float) -> str:
    return f"zip_with({a}, {b}, (x, y) -> (1 - {share}D) * x + {share}D * y)"


Model = Callable[[DataFrame], DataFrame]


def correct_clips(
    clips: DataFrame,
    bank: DataFrame,
    model: Model | None = None,
    guidance: float = 0.5,
    strength: float = 1.0,
    iterations: int = 20,
) -> DataFrame:
    """Corrected pose ``t`` of every clip on its own timing, with its matched expert.

    ``clips`` are 64-frame clips with ``anchors``; ``bank`` is already phase aligned.
    ``model`` maps a table with s (student), t (adapted expert) and own_c to the same
    table plus ``m`` (predicted pose); without it the prediction is the student itself.
    """
    if not 0 <= strength <= 1 or not 0 <= guidance <= 1:
        raise ValueError("guidance and strength must lie between zero and one")
    # matching reads both sides several times, and its result decides all later steps
    aligned, bank = settle(timewarp.phase_align(clips)), settle(bank)
    matches = settle(match_expert(aligned, bank, iterations))
    target = adapt_bone_lengths(with_expert(aligned, bank, matches), iterations)
    predicted = target.withColumn("m", F.col("s")) if model is None else model(target)
    mixed = predicted.withColumn("m", F.expr(_mix("m", "t", float(guidance)))).withColumn(
        "t", F.expr(_mix("s", "m", float(strength)))
    ).drop("m")
    projected = adapt_bone_lengths(mixed, iterations)
    delta = projected.withColumn("delta", F.expr("zip_with(t, s, (x, y) -> x - y)"))
    own_time = timewarp.restore_timing(
        delta.select(KEY, "frame", "anchors", "expert_id", "delta"), values=("delta",)
    )
    moved = clips.withColumnRenamed("p", "s").join(
        own_time.select(KEY, "frame", "expert_id", "delta"), [KEY, "frame"]
    ).withColumn("t", F.expr("zip_with(s, delta, (x, y) -> x + y)")).drop("delta")
    return adapt_bone_lengths(moved, iterations)


def correction_errors(clips: DataFrame, bank: DataFrame) -> DataFrame:
    """(clip_id, error) of every clip that :func:`correct_clips` has no rows for."""
    bad = timewarp.anchor_errors(clips).distinct()
    aligned = timewarp.phase_align(clips)
    rest = clips.select(KEY).distinct().join(bad.select(KEY), KEY, "left_anti")
    unmatched = match_errors(aligned, bank)
    unaligned = rest.join(aligned.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.lit("the clip could not be phase aligned").alias("error")
    )
    return bad.unionByName(unmatched).unionByName(unaligned)


def build_training_pairs(students: DataFrame, experts: DataFrame, iterations: int = 20) -> DataFrame:
    """Aligned training frames: students aim at their adapted expert, experts at themselves.

    Confidence is the smaller one of source and target; ``features`` holds source,
    target and source confidence of each joint (17 x 7).
    """
    matches = match_expert(students, experts, iterations)
    paired = adapt_bone_lengths(with_expert(students, experts, matches), iterations)
    own = experts.select(
        *[c for c in experts.columns if c not in ("p", "c")],
        F.col(KEY).alias("expert_id"),
        F.col("p").alias("s"),
        F.col("p").alias("t"),
        F.col("c").alias("own_c"),
        "c",
    )
    columns = [KEY, "frame", "skill", "handedness", "expert_id", "s", "t", "own_c", "c"]
    both = paired.select(*columns).unionByName(own.select(*columns))
    features = "flatten(transform(sequence(0, 16), j -> concat(slice(s, 3*j+1, 3), slice(t, 3*j+1, 3), array(own_c[j]))))"
    return both.withColumn("features", F.expr(features)).withColumn(
        "c", F.expr("zip_with(own_c, c, (a, b) -> least(a, b))")
    )


def match_pairs(students: DataFrame, bank: DataFrame, matches: DataFrame) -> DataFrame:
    """Unadapted student/expert pairs of the matches (product confidence)."""
    return with_expert(students, bank, matches).drop("own_c", "expert_c")


def dtw(pairs_: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Dynamic time warping of row pairs of tracks (arrays of points): path and cost.

    One row holds one pair, so the work spreads over pairs. Time is quadratic in the track
    length; memory is a band of the cost table and one row per band.
    """
    fields = [pairs_.schema[k] for k in keys] + [
        T.StructField("cost", T.DoubleType()),
        T.StructField("path", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))),
    ]
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, y = np.stack(row[a]), np.stack(row[b])
                path, cost = kernels.warping_path(x, y)
                out.append((*[row[k] for k in keys], cost, [{"i": int(i), "j": int(j)} for i, j in path]))
            yield pd.DataFrame(out, columns=schema.names)

    ship_package(pairs_.sparkSession)
    return pairs_.select(*keys, a, b).mapInPandas(run, schema)


def overlay_coordinates(pairs_: DataFrame, keys: Sequence[str] = (KEY, "frame")) -> DataFrame:
    """Pixel positions of corrected joints: per-frame least-squares affine 3-D -> 2-D.

    Needs ``s`` (3-D student, 51), ``px`` (34 pixels), ``t`` (corrected, 51), ``c`` (17).
    Joints with confidence above 0.05 take part; frames with fewer than three give an
    error row. Rank-deficient frames use the minimum-norm solution.
    """
    schema = T.StructType(
        [pairs_.schema[k] for k in keys]
        + [T.StructField("pixels", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s = _stack(batch["s"]).reshape(-1, spec.JOINTS, 3)
            t = _stack(batch["t"]).reshape(-1, spec.JOINTS, 3)
            px = _stack(batch["px"]).reshape(-1, spec.JOINTS, 2)
            use = (_stack(batch["c"]) > 0.05) & np.isfinite(s).all(-1) & np.isfinite(px).all(-1)
            one = np.ones((*s.shape[:2], 1))
            left = np.where(use[..., None], np.concatenate([s, one], -1), 0.0)
            right = np.where(use[..., None], px, 0.0)
            fit = np.linalg.pinv(left) @ right
            mapped = (np.concatenate([t, one], -1) @ fit).reshape(len(batch), -1)
            enough = use.sum(1) >= 3
            out = batch[list(keys)].copy()
            out["pixels"] = [m if ok else None for m, ok in zip(mapped, enough)]
            out["error"] = np.where(enough, "", "at least three visible joints are required")
            yield out

    ship_package(pairs_.sparkSession)
    return pairs_.select(*keys, "s", "t", "px", "c").mapInPandas(run, schema)


__all__ = [
    "adapt_bone_lengths",
    "build_training_pairs",
    "correct_clips",
    "correction_errors",
    "dtw",
    "match_expert",
    "match_errors",
    "match_expert_euclidean",
    "match_pairs",
    "nearest_expert",
    "overlay_coordinates",
    "pairs",
    "with_expert",
    "without_expert",
]
