"""Ingest of clip archives that decodes only what is new or changed.

A run lists the files, leaves out those whose path, length and time stand in the manifest,
reads the rest, and decodes only contents whose digest is new for their path. Decoded clips
and manifest rows are upserts into stored tables, so the clip store and the summary grow by
run; a file that is gone takes its clip along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.functions.columns import file_stem
from motionlake.session import settle
from motionlake.sources import archives
from motionlake.streaming import jobs as J

#: Changed files up to which their paths are named to the reader; beyond it all contents
#: are scanned and the others dropped.
NAMED_FILES = 10_000
GLOB = "*.npz"


def _list(spark: SparkSession, path: str | list[str], deep: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if deep:
        reader = reader.option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true")
    return reader.load(path)


def ingest_changes(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Bring the store under ``out`` up to date; returns (path, action) of this run.

    Actions are ``decoded``, ``touched`` (same content under a new time) and ``removed``;
    files without a change are not mentioned. Broken archives are decoded to error rows.
    """
    files = settle(_list(spark, path).select("path", "length", "modificationTime"))
    manifest = J.read_latest(spark, f"{out}/manifest")
    if manifest is None:
        known = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp, digest string, run bigint")
    else:
        known = manifest.where("digest IS NOT NULL").select("path", "length", "modificationTime", "digest", "run")
    known = settle(known)
    # Runs count on from the stored rows, also those of files that are gone.
    run = 1 if manifest is None else (manifest.agg(F.max("run")).first()[0] or 0) + 1
    changed = settle(files.join(known, ["path", "length", "modificationTime"], "left_anti"))
    n = changed.count()
    removed = known.join(files.select("path"), "path", "left_anti").select("path")
    if n == 0:
        contents = None
    elif n <= NAMED_FILES:
        contents = _list(spark, [r.path for r in changed.select("path").collect()], False)
    else:
        contents = _list(spark, path).join(changed.select("path"), "path", "left_semi")
    gone = removed.select("path", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("string").alias("digest"))
    entries, actions = gone, removed.select("path", F.lit("removed").alias("action"))
    label = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    if contents is not None:
        read = contents.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("digest"))
        old = known.select("path", F.col("digest").alias("_old"))
        fresh = read.join(old, "path", "left").where("NOT (digest <=> _old)")
        decoded = settle(archives.decode(fresh.select("path", "content")))
        clips = decoded.withColumns({"clip_id": file_stem(F.col("path")), "label": label, "run": F.lit(run).cast("bigint"), "gone": F.lit(False)})
        J.latest_writer(f"{out}/clips", ["run"], "path")(clips, run)
        digests = settle(read.drop("content").join(old, "path", "left"))
        entries = entries.unionByName(digests.drop("_old"))
        action = F.when(F.col("digest").eqNullSafe(F.col("_old")), "touched").otherwise("decoded")
        actions = actions.unionByName(digests.select("path", action.alias("action")))
    actions, entries = settle(actions), settle(entries)
    lost = entries.where("digest IS NULL").select("path")
    stored = J.read_latest(spark, f"{out}/clips")
    if stored is not None and not lost.isEmpty():
        blank = stored.drop("bucket").join(lost, "path", "left_semi").withColumns({"run": F.lit(run).cast("bigint"), "gone": F.lit(True)})
        J.latest_writer(f"{out}/clips", ["run"], "path")(settle(blank), run)
    if not entries.isEmpty():
        J.latest_writer(f"{out}/manifest", ["run"], "path")(entries.withColumn("run", F.lit(run).cast("bigint")), run)
    return actions


def stored_clips(spark: SparkSession, out: str) -> DataFrame:
    """All clips of files that are there, errors included."""
    clips = J.read_latest(spark, f"{out}/clips")
    if clips is None:
        raise ValueError(f"nothing was ingested to {out}")
    return clips.where("NOT gone").drop("bucket", "gone", "run")


def ingest_summary(spark: SparkSession, out: str) -> DataFrame:
    """One row per file: clip, label, skill, frames, status and error."""
    failed = F.col("error") != ""
    return stored_clips(spark, out).select(
        "path", "clip_id", "label", "skill",
        F.when(failed, 0).otherwise(F.size("seq")).alias("frames"),
        F.when(failed, "error").otherwise("success").alias("status"),
        "error",
    )
