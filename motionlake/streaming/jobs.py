"""Structured Streaming jobs. Each is a lazy transformation; the caller starts the query.

Event time is column ``ts``; late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motionlake.operators.annotations import latest_annotations
from motionlake.session import ship_package

KEY = "clip_id"
WATERMARK = "1 hour"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def observations(stream: DataFrame, keys: tuple[str, ...] = (KEY, "frame"), watermark: str = WATERMARK) -> DataFrame:
    """Each observation once, however often it is delivered within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def throughput(stream: DataFrame, key: str = KEY, window: str = "10 seconds", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Frames per window and clip, with the span they cover."""
    bucket = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = stream.withWatermark("ts", watermark).groupBy(bucket.alias("w"), key).agg(
        F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return out.select(
        F.col("w.start").alias("window_start"), key, "frames",
        F.when(F.col("frames") > 1, span / (F.col("frames") - 1)).alias("mean_interval"),
    )


def complete_clips(stream: DataFrame, key: str = KEY, gap: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """A clip is complete when nothing arrived for ``gap``: one row per session."""
    return stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), key).agg(
        F.count(F.lit(1)).alias("frames")
    ).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "frames")


#: Versions between two full rewrites of the upsert state.
FULL_EVERY = 8


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Committed versions of the upsert state, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(target)
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def _drop_version(spark: SparkSession, target: str, version: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/version={version}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def latest_writer(target: str, order: list[str], key: str = "sample_id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps the last write per key.

    State is Parquet partitioned by a hash bucket of the key. A batch rewrites the buckets
    it touches into the next version after the newest committed one; the number comes from
    the stored state, not from the batch, so a query that starts again with a new
    checkpoint continues the state, and a retried batch changes nothing, because keeping
    the last write is idempotent. Every ``FULL_EVERY``-th version holds all buckets, and
    versions before the previous full one are deleted: at most twice that many exist.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        versions = _versions(spark, target)
        version = versions[-1] + 1 if versions else 1
        merged = latest_annotations(batch, order, key).withColumn("bucket", bucket)
        current = read_latest(spark, target)
        if current is not None:
            if version % FULL_EVERY:
                # At most `buckets` rows, a fixed parameter.
                current = current.join(F.broadcast(merged.select("bucket").distinct()), "bucket", "left_semi")
            merged = latest_annotations(merged.unionByName(current).drop("bucket"), order, key).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={version}")
        if version % FULL_EVERY == 0:
            for old in versions:
                if old < version - FULL_EVERY:
                    _drop_version(spark, target, old)

    return write


def read_latest(spark: SparkSession, target: str) -> DataFrame | None:
    """Current state: for every bucket the rows of its highest committed version."""
    versions = _versions(spark, target)
    if not versions:  # nothing has been written yet
        return None
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/version={v}" for v in versions])
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    state = rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")
    return state.drop("version")


class CarryForward(StatefulProcessor):
    """Boxes of the last detection per clip, refreshed every ``every`` frames or when empty.

    With ``idle_ms`` the state of a clip expires when none of its frames came for so long.
    """

    def __init__(self, every: int, idle_ms: int | None) -> None:
        self.every = every
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "seen int, detected_at bigint, boxes int"
        self.last = handle.getValueState("last", schema, **({"ttlDurationMs": self.idle_ms} if self.idle_ms else {}))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else (0, None, 0)
        seen, detected_at, boxes = state
        # Frames and counts of one clip and one micro-batch: two numbers a frame.
        batch = pd.concat([r[["frame", "boxes"]] for r in rows]).sort_values("frame")
        out = []
        for frame, found in zip(batch["frame"], batch["boxes"]):
            if seen % self.every == 0 or not boxes:
                detected_at, boxes = int(frame), int(found)
            out.append((key[0], int(frame), detected_at if boxes else -1, boxes))
            seen += 1
        self.last.update((seen, detected_at, boxes))
        yield pd.DataFrame(out, columns=[KEY, "frame", "detected_at", "boxes"])

    def close(self) -> None:
        pass


def carry_forward(stream: DataFrame, every: int = 7, key_type: str = "int", idle_ms: int | None = None) -> DataFrame:
    """Frames (clip_id, frame, boxes found) -> the detection each frame uses.

    ``detected_at`` -1 means the whole image. Needs the RocksDB state store. ``idle_ms``
    bounds the state of a stream that runs on; a stream with an end (``availableNow``)
    leaves it out, because processing-time expiry keeps such a query waiting for time.
    """
    ship_package(stream.sparkSession)
    return stream.groupBy(KEY).transformWithStateInPandas(
        CarryForward(every, idle_ms), f"{KEY} {key_type}, frame bigint, detected_at bigint, boxes int", "Append", "ProcessingTime" if idle_ms else "None"
    )
