"""Detections carried forward over frames (batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.ordered import number_rows
from motionlake.functions.timeblocks import BLOCK_FRAMES

KEY = "clip_id"


def carry_forward(frames: DataFrame, every: int = 7, key: str = KEY) -> DataFrame:
    """Detection frame used by every frame when detection runs each ``every`` frames.

    The schedule counts the frames of a clip that are there, so gaps in their numbers do
    not shift it; the streaming form follows the same rule.
    Between two scheduled runs an empty result is retried on every frame until boxes
    appear: a frame is served by the first frame with boxes since the last scheduled
    run, or by none (-1, the whole image) before it. Only rows of one interval of
    ``every`` frames look at each other.
    """
    frames = number_rows(frames, [key], ["frame"], F.floor(F.col("frame") / BLOCK_FRAMES), "_n")
    rows = frames.withColumn("_i", F.floor(F.col("_n") / every))
    found = F.when(F.col("boxes") > 0, F.struct("frame", "boxes"))
    # a window holds the `every` frames of one interval
    joined = rows.withColumn("_d", F.min(found).over(Window.partitionBy(key, "_i")))
    ready = F.col("_d.frame") <= F.col("frame")
    return joined.select(
        key, "frame",
        F.when(ready, F.col("_d.frame")).otherwise(-1).cast("bigint").alias("detected_at"),
        F.when(ready, F.col("_d.boxes")).otherwise(0).cast("int").alias("boxes"),
    )
