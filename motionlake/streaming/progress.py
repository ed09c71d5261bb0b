"""Annotation progress that every write keeps up to date.

A batch of annotation writes changes the state of some samples. Beside the upsert state this
sink stores, per version of that state, change rows: -1 for the state a sample leaves and +1
for the one it takes, summed per facet combination. Progress is the sum of the changes, so
reading it never looks at samples or annotations again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.operators import annotations as A
from motionlake.session import settle
from motionlake.streaming import jobs as J

BY = ("skill", "key_frame", "cohort")
#: Versions between two folds of the changes.
FOLD_EVERY = 16


def _counts(samples: DataFrame, annotations: DataFrame, by: Sequence[str], key: str, sign: int) -> DataFrame:
    return A.with_state(samples, annotations, key).groupBy(*by, "state").agg((F.lit(sign) * F.count(F.lit(1))).alias("n"))


def _sum(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return parts.groupBy(*by, "state").agg(F.sum("n").alias("n")).where("n <> 0")


def progress_writer(
    target: str, samples: DataFrame, order: Sequence[str], by: Sequence[str] = BY, key: str = "sample_id", buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the upsert state under ``target/state`` and its progress.

    Changes are computed against the newest committed version of the state and stored under
    its number before the next version is written. A batch that runs again after a failure
    either finds the state as it was and replaces its own changes, or finds it written and
    adds none. ``samples`` is fixed; writes of unknown samples count nowhere.
    """
    state = f"{target}/state"
    write_state = J.latest_writer(state, list(order), key, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = J._versions(spark, state)
        version = versions[-1] if versions else 0
        fresh = settle(A.latest_annotations(batch, order, key))
        touched = fresh.select(key)
        old = J.read_latest(spark, state)
        before = fresh.limit(0) if old is None else old.drop("bucket").join(touched, key, "left_semi").select(fresh.columns)
        after = A.latest_annotations(fresh.unionByName(before), order, key)
        mine = samples.join(touched, key, "left_semi")
        change = _counts(mine, after, by, key, 1).unionByName(_counts(mine, before, by, key, -1))
        if not versions:
            change = change.unionByName(_counts(samples, fresh.limit(0), by, key, 1))
        _sum(change, by).coalesce(1).write.mode("overwrite").parquet(f"{target}/changes/version={version}")
        if version and version % FOLD_EVERY == 0 and version not in J._versions(spark, f"{target}/folded"):
            _progress(spark, target, by, version).coalesce(1).write.mode("overwrite").parquet(f"{target}/folded/version={version}")
        write_state(batch, batch_id)

    return write


def _progress(spark: SparkSession, target: str, by: Sequence[str], version: int) -> DataFrame:
    """Counts at a version: the last fold up to it and the changes since."""
    folds = [v for v in J._versions(spark, f"{target}/folded") if v <= version]
    since = folds[-1] if folds else 0
    parts = [f"{target}/changes/version={v}" for v in J._versions(spark, f"{target}/changes") if since <= v < version]
    if folds:
        parts.append(f"{target}/folded/version={since}")
    rows = spark.read.parquet(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(spark.read.parquet(part))
    return _sum(rows, by)


def read_progress(spark: SparkSession, target: str, by: Sequence[str] = BY) -> DataFrame | None:
    """Samples per facet combination and state after the last committed write."""
    versions = J._versions(spark, f"{target}/state")
    return _progress(spark, target, by, versions[-1]) if versions else None
