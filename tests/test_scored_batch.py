"""Rows of a streamed batch reach their sessions without passing through the driver."""

import pytest
from pyspark.sql import functions as F
from test_clip_streams import SCHEMA, at

from motionlake.streaming import clips as C


class Seen(Exception):
    pass


def test_rows_of_a_batch_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = [(c, f, at(f), d, j, 0.0, 0.0, 0.0, 0.9) for c in range(3) for f in range(4) for d in (2, 3) for j in range(3)]
    spark.createDataFrame(rows, SCHEMA).drop("ts").withColumn("session", F.lit(0).cast("long")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))  # a small file: its rows would be broadcast
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        if "_nth" in df.columns and "joint" in df.columns:
            raise Seen
        return store(df)

    store = C.settle
    monkeypatch.setattr(C, "settle", noted)
    with pytest.raises(Seen):
        C.scorer(batch, batch, batch, str(tmp_path / "out"))(batch, 0)
    assert "Join" in plans[-1] and not any("BroadcastHashJoin" in p for p in plans)
