"""Clip archives: listing, one-off ingest to Parquet, reading and writing clips."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake import spec
from motionlake.functions.columns import file_name, file_stem, file_suffix
from motionlake.session import ship_package

MEDIA_SUFFIXES = (".mp4", ".mov")

CLIP_SCHEMA = (
    "path string, skill string, handedness string, video_name string, source_video_name string, "
    "analysis_window array<int>, phase_indices array<int>, source_frame_indices array<int>, "
    "source_phase_indices array<int>, fps double, seq array<array<double>>, "
    "seq2d array<array<double>>, conf array<array<double>>, error string"
)


def list_sequences(spark: SparkSession, root: str, label: str | None = None, suffix: str = "npz") -> DataFrame:
    """Archive files below ``root[/label]`` in path order; no content is read."""
    base = f"{root}/{label}" if label else root
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(base)
    return files.select("path", "length", "modificationTime").orderBy("path")


def list_media(
    spark: SparkSession, path: str, suffixes: Sequence[str] = MEDIA_SUFFIXES, only: DataFrame | None = None
) -> DataFrame:
    """Media files by lower-cased suffix, optionally limited to the names in ``only``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    named = files.withColumn("filename", file_name(F.col("path")))
    chosen = named.where(file_suffix(F.col("path")).isin(*suffixes))
    if only is not None:
        chosen = chosen.join(only.select("filename").distinct(), "filename", "left_semi")
    return chosen.orderBy("path")


def _decode(path: str, content: bytes) -> dict:
    row = {name.split(" ")[0]: None for name in CLIP_SCHEMA.split(", ")}
    row["path"] = path
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            have = set(data.files)
            for name in ("skill", "handedness", "video_name", "source_video_name"):
                row[name] = str(data[name].item()) if name in have else None
            for name in ("analysis_window", "phase_indices", "source_frame_indices", "source_phase_indices"):
                row[name] = data[name].astype(int).tolist() if name in have else None
            row["fps"] = float(data["fps"]) if "fps" in have else None
            for name, key in (("seq", "skeleton_3d"), ("seq2d", "skeleton_2d")):
                if key in have:
                    row[name] = data[key].reshape(len(data[key]), -1).astype(float).tolist()
            row["conf"] = data["confidence"].astype(float).tolist()
            row["error"] = "" if row["seq"] is not None else "archive has no 3-D sequence"
    except Exception as exc:  # a broken archive becomes an error row, the rest go on
        row["error"] = f"{type(exc).__name__}: {exc}"
    return row


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive; unreadable files carry an error instead of failing the job."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.npz")
        .option("recursiveFileLookup", "true").load(path).select("path", "content")
    )
    return decode(files)


def decode(files: DataFrame) -> DataFrame:
    """Archives as (path, content) to clip rows; a broken one is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split(" ")[0] for part in CLIP_SCHEMA.split(", ")]
        for batch in batches:
            rows = [_decode(p, c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=names)

    ship_package(files.sparkSession)
    return files.mapInPandas(run, CLIP_SCHEMA)


def ingest_archives(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Decode archives once and store them as partitioned Parquet; returns the errors."""
    decoded = load_archives(spark, path).withColumn("clip_id", file_stem(F.col("path"))).withColumn(
        "label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    )
    write_clips(decoded.drop("path"), out, mode="overwrite")
    return read_clips(spark, out).where("error <> ''").select("clip_id", "error")


def write_clips(clips: DataFrame, path: str, mode: str = "append") -> None:
    clips.write.partitionBy("skill", "label").mode(mode).parquet(path)


def read_clips(spark: SparkSession, path: str, skill: str | None = None, label: str | None = None) -> DataFrame:
    """Stored clips; skill and label prune partitions."""
    clips = spark.read.parquet(path)
    if skill:
        clips = clips.where(F.col("skill") == skill)
    if label:
        clips = clips.where(F.col("label") == label)
    return clips


def clip_frames(clips: DataFrame) -> DataFrame:
    """Stored clips as frames (clip_id, frame, p, c) with their metadata."""
    keep = [c for c in clips.columns if c not in ("seq", "seq2d", "conf", "error")]
    return clips.where("error = ''").select(*keep, "conf", F.posexplode("seq").alias("frame", "p")).withColumn(
        "c", F.get("conf", F.col("frame"))
    ).drop("conf")


def expert_sources(files: DataFrame, root: str, exclude: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Files directly inside root/<skill>/left or /right; deeper and excluded folders do not count."""
    skills = "|".join(spec.SKILLS)
    folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    allowed = folder.rlike(rf"^{root}/({skills})/(left|right)$")
    return files.where(allowed & ~folder.isin(*exclude)) if exclude else files.where(allowed)
