"""Tabular sources and sinks: grades, manifests, overrides, calibrations, annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "skill string, group string, role string, subject string, handedness string, "
    "video_path string, baseline_path string"
)
CALIBRATION_SCHEMA = (
    "skill string, distance_offset double, alpha double, target_beginner_mean double, "
    "target_expert_mean double, target_reachable boolean"
)
OLD_SCORE_SCHEMA = "filename string, label string, total_grade double"
ANNOTATION_SCHEMA = (
    "sample_id string, image string, metadata struct<skill:string,key_frame_name:string,"
    "cohort:string,source_dataset:string,angles:map<string,double>>, "
    "expert_annotation struct<score:double,feedback:string,correction_suggestion:string>"
)


def read_grades(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Grading CSV as text columns; names every required column that is missing."""
    grades = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in grades.columns]
    if missing:
        raise ValueError(f"grading table lacks columns: {', '.join(missing)}")
    return grades


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header in every part; the table is never pulled into one task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def ragged_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; the header is their sorted union."""
    both = frames[0]
    for other in frames[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.select(*sorted(both.columns))


def write_documents(df: DataFrame, path: str, document: str = "document") -> None:
    """One JSON document per line."""
    df.select(F.col(document).alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order column, file by file."""
    lines = spark.read.text(path)
    return lines.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line"),
        F.get_json_object("value", "$.filename").alias("filename"),
        F.col("value").alias("document"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST_SCHEMA)


def write_calibration(calibration: DataFrame, path: str) -> None:
    calibration.write.mode("overwrite").json(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration records; no record at all is an error."""
    table = spark.read.schema(CALIBRATION_SCHEMA).json(path)
    if table.isEmpty():
        raise ValueError(f"no calibration found in {path}")
    return table


def handedness_overrides(texts: DataFrame, text: str = "value") -> DataFrame:
    """(filename, handedness, error) from JSON objects that map file names to a hand.

    An object that cannot be read is one row without a name, with an error.
    """
    parsed = texts.select(F.from_json(text, "map<string,string>").alias("m"))
    rows = parsed.select(F.col("m").isNull().alias("_broken"), F.explode_outer("m").alias("filename", "_h"))
    hand = F.lower("_h")
    good = F.coalesce(hand.isin("left", "right"), F.lit(False))
    return rows.where(F.col("_broken") | F.col("filename").isNotNull()).select(
        "filename",
        F.when(good, hand).alias("handedness"),
        F.when(F.col("_broken"), "the overrides cannot be read")
        .when(good, "")
        .otherwise("handedness must be left or right")
        .alias("error"),
    )


def concat_scores(beginners: DataFrame | None, experts: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Old scores of both cohorts with their label; none at all gives an empty table."""
    parts = [
        df.select("filename", F.lit(label).alias("label"), F.col("total_grade").cast("double").alias("total_grade"))
        for df, label in ((beginners, "beginners"), (experts, "experts"))
        if df is not None
    ]
    if not parts:
        return spark.createDataFrame([], OLD_SCORE_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Annotation samples from JSON lines; blank lines are skipped."""
    return parse_samples(spark.read.text(path))


def parse_samples(lines: DataFrame, text: str = "value") -> DataFrame:
    trimmed = lines.select(F.trim(text).alias("_t")).where(F.col("_t") != "")
    return trimmed.select(F.from_json("_t", ANNOTATION_SCHEMA).alias("d")).select("d.*")
