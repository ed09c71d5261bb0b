"""Time-series windows that cut a long track into blocks of frames.

A track is partitioned by ``(track, block)`` with ``block = frame div size``. Rows a
block needs from its neighbours (the halo) are copied to it, so row-offset windows are
exact and no task ever sees more than one block. Unbounded look-back and look-ahead
(gap filling, as-of) carries one summary row per block instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_FRAMES = 16384


def with_halo(
    df: DataFrame,
    order: str = "frame",
    before: int = 0,
    after: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Add ``_block`` and copies of the rows neighbouring blocks look at.

    ``before``/``after`` are how many frames a row's window reaches back/ahead.
    """
    size = size or BLOCK_FRAMES
    f = F.col(order)
    # A halo longer than a block reaches several of them.
    first, last = F.floor(F.greatest(f - after, F.lit(0)) / size), F.floor((f + before) / size)
    return df.withColumn("_block", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, order: str = "frame", size: int | None = None) -> DataFrame:
    """Drop the halo copies again."""
    size = size or BLOCK_FRAMES
    return df.where(F.floor(F.col(order) / size) == F.col("_block")).drop("_block")


def block_window(keys: Sequence[str], order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(order)


def box_mean(value: str, keys: Sequence[str], window: int, order: str = "frame") -> Column:
    """Centred mean with edge replication; needs a halo of window//2 on both sides."""
    half = window // 2
    w = block_window(keys, order)
    near = w.rowsBetween(-half, half)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = F.col(order)
    missing_left = F.greatest(F.lit(0), F.lit(half) - f)
    missing_right = F.greatest(F.lit(0), f + half - F.max(order).over(whole))
    return (
        F.sum(value).over(near)
        + missing_left * F.first(value).over(whole)
        + missing_right * F.last(value).over(whole)
    ) / F.lit(float(window))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    valid: Column,
    payload: Sequence[str],
    order: str = "frame",
    size: int | None = None,
) -> DataFrame:
    """Add structs ``_prev``/``_next``: nearest valid row at or before/after each row.

    ``order`` must be non-negative and unique per key for deterministic answers.
    """
    size = size or BLOCK_FRAMES
    item = F.when(valid, F.struct(F.col(order).alias("at"), *[F.col(c) for c in payload]))
    rows = df.withColumn("_block", F.floor(F.col(order) / size)).withColumn("_item", item)
    w = block_window(keys, order)
    inside = rows.withColumn(
        "_prev",
        F.last("_item", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn(
        "_next",
        F.first("_item", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    )
    summary = rows.groupBy(*keys, "_block").agg(
        F.min("_item").alias("_first"), F.max("_item").alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = summary.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry_prev"),
        F.first("_first", ignorenulls=True)
        .over(across.rowsBetween(1, Window.unboundedFollowing))
        .alias("_carry_next"),
    )
    return (
        inside.join(carried, [*keys, "_block"])
        .withColumn("_prev", F.coalesce("_prev", "_carry_prev"))
        .withColumn("_next", F.coalesce("_next", "_carry_next"))
        .drop("_block", "_item", "_carry_prev", "_carry_next")
    )


def rows_in_interval(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    order: str = "frame",
    size: int | None = None,
) -> DataFrame:
    """Rows whose ``order`` lies in [low, high], joined on (keys, block).

    An interval is copied once per block it touches, so a long track is spread over
    its blocks instead of meeting its interval in one task.
    """
    size = size or BLOCK_FRAMES
    wide = intervals.where(F.col(low) <= F.col(high)).withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))),
    )
    return (
        rows.withColumn("_block", F.floor(F.col(order) / size))
        .join(wide, [*keys, "_block"])
        .where((F.col(order) >= F.col(low)) & (F.col(order) <= F.col(high)))
        .drop("_block")
    )


def join_per_key(
    rows: DataFrame,
    params: DataFrame,
    keys: Sequence[str],
    last: str,
    order: str = "frame",
    size: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join one parameter row per key to that key's rows, block by block.

    ``last`` names the column of ``params`` with the key's largest frame; the column
    is consumed. Same idea as salting, with the block of frames as the salt.
    """
    size = size or BLOCK_FRAMES
    wide = params.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(last) / size)))
    ).drop(last)
    return (
        rows.withColumn("_block", F.floor(F.col(order) / size))
        .join(wide, [*keys, "_block"], how)
        .drop("_block")
    )
