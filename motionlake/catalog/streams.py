"""Stream jobs: the streams themselves and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motionlake.catalog.notes import STATE
from motionlake.catalog.notes import _samples as annotated
from motionlake.catalog.registry import query
from motionlake.catalog.views import ANNOTATION_SQL, JOINT7_SQL, UPSERT_SQL, joint7, pose_joints, table, upserts
from motionlake.operators import annotations as A
from motionlake.operators import detections as D
from motionlake.session import scratch_folder, settle
from motionlake.streaming import clips as C
from motionlake.streaming import jobs as J
from motionlake.streaming import progress

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _table_stream(spark, sf_dir, name, schema):
    """A table as a stream, whether it is one file or a folder of files.

    A pattern in the last letter lets the source list either kind.
    """
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark, sf_dir):
    stream = _table_stream(spark, sf_dir, "events", EVENT_SCHEMA)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark, df):
    """Run a stream over everything available into Parquet and read that back."""
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    )
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


ARRIVALS = 3


def _arriving(spark, rows, arrival):
    """``rows`` as a stream of ``ARRIVALS`` deliveries by the second ``arrival``, and its watermark.

    Rows come in any order inside a delivery, so the watermark spans two of them. A last
    observation, far later, lets it pass all others.
    """
    folder = f"{scratch_folder(spark)}/arriving-{uuid.uuid4().hex}"
    rows = settle(rows.withColumn("_at", arrival))
    plain = [F.lit(1).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("clip_id", "ts", "_at")]
    step = ((rows.agg(F.max("_at")).first()[0] or 0) + 1) / ARRIVALS
    last = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast(rows.schema["clip_id"].dataType).alias("clip_id"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), *plain
    )
    files = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    for k in range(ARRIVALS):
        low, high = k * step, (k + 1) * step if k + 1 < ARRIVALS else float("inf")
        part = rows.where((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at")
        part.repartition(files).write.mode("append").parquet(folder)
    last.select(*[c for c in rows.columns if c != "_at"]).write.mode("append").parquet(folder)
    # a delivery is one batch: every batch visits the state of all clips
    return J.read_stream(spark, folder, rows.drop("_at").schema.toDDL(), files), f"{int(2 * step) + 5} seconds"


@query(
    "st1_ordered_frames_stream",
    ctes=(JOINT7_SQL, """
obs AS (SELECT clip_id, frame, joint, x, y, z, 3 dims FROM joint7 WHERE x > 5::DOUBLE UNION ALL SELECT clip_id, frame, joint, x, y, z, 2 FROM joint7 WHERE x > 5::DOUBLE AND n = 1),
kept AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 nth FROM obs GROUP BY 1, 2
  HAVING bool_or(dims = 3 AND joint = 1) AND bool_or(dims = 2 AND joint = 1))"""),
    sql="""SELECT clip_id, CAST(nth AS INT) frame, CAST(frame AS BIGINT) source_frame, CAST(dims AS INT) dims, CAST(joint AS INT) joint, round(x, 9) x, round(y, 9) y, round(z, 9) z
FROM obs JOIN kept USING (clip_id, frame)""",
)
def st1_ordered(spark, sf_dir):
    """Joints of orders that arrive up to 3 s out of order, one frame a second."""
    rows = joint7(spark, sf_dir).withColumn("score", F.col("x") / 10)
    rows = rows.withColumn("dims", F.explode(F.when(F.col("n") == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_700_000_000))
    late = F.pmod(F.xxhash64("clip_id", "frame", "joint", "dims"), F.lit(4))
    columns = ["clip_id", "frame", "ts", "dims", "joint", "x", "y", "z", "score"]
    stream, watermark = _arriving(spark, rows.select(*columns), F.col("frame") + late)
    with C.state_store(spark):
        out = _drain(spark, C.ordered_frames(stream, (1,), watermark=watermark))
    return out.select("clip_id", "frame", "source_frame", "dims", "joint", *[F.round(a, 9).alias(a) for a in ("x", "y", "z")])


@query("st1_observation_stream", sql="SELECT event_id, user_id, value FROM events")
def st1(spark, sf_dir):
    return _drain(spark, J.observations(_events(spark, sf_dir), ("event_id",)).select("event_id", "user_id", "value"))


WINDOW_SQL = """
SELECT user_id, epoch_us(w) window_start, frames, CASE WHEN frames > 1 THEN (epoch_us(b) - epoch_us(a)) / 1e6::DOUBLE / (frames - 1) END mean_interval
FROM (SELECT user_id, date_trunc('day', ts) w, count(*) frames, min(ts) a, max(ts) b FROM events GROUP BY 1, 2)"""


@query(
    "st3_throughput_stream",
    sql=WINDOW_SQL + " WHERE epoch_us(w) + 86400000000 <= (SELECT floor(epoch_us(max(ts)) / 1000) * 1000 - 3600000000 FROM events)",
)
def st3(spark, sf_dir):
    out = _drain(spark, J.throughput(_events(spark, sf_dir), "user_id", "1 day"))
    return out.select("user_id", F.unix_micros("window_start").alias("window_start"), "frames", "mean_interval")


@query("st3_throughput_batch", sql=WINDOW_SQL)
def st3_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.throughput(rows, "user_id", "1 day")
    return out.select("user_id", F.unix_micros("window_start").alias("window_start"), "frames", "mean_interval")


SESSION_SQL = """
SELECT user_id, min(us) started, max(us) + 43200000000 ended, count(*) frames FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) s FROM (
    SELECT user_id, event_id, epoch_us(ts) us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END brk FROM events)) GROUP BY user_id, s"""


@query(
    "st5_complete_clips_stream",
    sql=f"SELECT * FROM ({SESSION_SQL}) WHERE ended <= (SELECT floor(epoch_us(max(ts)) / 1000) * 1000 - 3600000000 FROM events)",
)
def st5(spark, sf_dir):
    out = _drain(spark, J.complete_clips(_events(spark, sf_dir), "user_id", "12 hours"))
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "frames")


@query("st5_complete_clips_batch", sql=SESSION_SQL)
def st5_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.complete_clips(rows, "user_id", "12 hours")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "frames")


@query(
    "st5_whole_clips_stream",
    sql="""WITH b AS (SELECT *, epoch_us(ts) us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) s FROM b),
e AS (SELECT *, min(us) OVER (PARTITION BY user_id, s) session, max(us) OVER (PARTITION BY user_id, s) last FROM s)
SELECT user_id, session, event_id, value FROM e WHERE last + 43200000000 + 2000 <= (SELECT floor(epoch_us(max(ts)) / 1000) * 1000 - 3600000000 FROM events)""",
)
def st5_whole(spark, sf_dir):
    """All events of every session that is over, half a day after its last one."""
    stream = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    with C.state_store(spark):
        out = _drain(spark, C.whole_clips(stream, "user_id", 12 * 3600, "1 hour"))
    return out.select("user_id", "session", "event_id", "value")


@query("st5_scored_clips_stream")
def st5_scored(spark, sf_dir):
    """Poses as a stream, graded clip by clip once they are complete; equals c15_grade_batch."""
    from motionlake.catalog.distances import calibration
    from motionlake.catalog.jobs import prepared, recordings

    bank = settle(prepared(spark, sf_dir)[0].where("label = 'experts'"))
    seen = pose_joints(spark, sf_dir).where("conf > 0")
    rows = seen.withColumn("dims", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("score", F.lit(1.0))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("clip_id") % 1000 * 5 + F.col("frame") + 1_700_000_000))
    late = F.pmod(F.xxhash64("clip_id", "frame", "joint", "dims"), F.lit(4))
    columns = ["clip_id", "frame", "ts", "dims", "joint", "x", "y", "z", "score"]
    stream, _ = _arriving(spark, rows.select(*columns), F.unix_seconds("ts") - 1_700_000_000 + late)
    folder = f"{scratch_folder(spark)}/graded-{uuid.uuid4().hex}"
    sink = C.scorer(recordings(spark, sf_dir), bank, calibration(spark), f"{folder}/out")
    with C.state_store(spark):
        # The last observation completes all clips at once, so they are graded in one batch.
        run = C.whole_clips(stream, gap_seconds=15, watermark="100 days").writeStream.foreachBatch(sink)
        run.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return C.read_scores(spark, f"{folder}/out").drop("session")


CARRY_SQL = """
f0 AS (SELECT l_orderkey % 100 clip_id, l_orderkey // 100 frame, CAST(count(*) FILTER (l_discount < 0.03) AS INT) boxes FROM lineitem GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 n FROM f0),
fi AS (SELECT clip_id, n // 7 i, min(frame) f, arg_min(boxes, frame) b FROM fr WHERE boxes > 0 GROUP BY 1, 2)"""


def _detected(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy((key % 100).alias("clip_id"), F.floor(key / 100).alias("frame")).agg(
        F.sum((F.col("l_discount") < 0.03).cast("int")).cast("int").alias("boxes")
    )


@query(
    "w28_detection_carry_forward",
    ctes=(CARRY_SQL,),
    sql="SELECT fr.clip_id, fr.frame, CASE WHEN f <= frame THEN f ELSE -1 END detected_at, CASE WHEN f <= frame THEN b ELSE 0 END boxes FROM fr LEFT JOIN fi ON fi.clip_id = fr.clip_id AND fi.i = fr.n // 7",
)
def w28(spark, sf_dir):
    return D.carry_forward(_detected(spark, sf_dir))


@query("st4_annotation_upserts", ctes=(UPSERT_SQL,), sql="SELECT sample_id, seq, author, feedback FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC, author DESC, feedback DESC) rn FROM ups) WHERE rn = 1")
def st4(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/upserts-{uuid.uuid4().hex}"
    stream = _table_stream(spark, sf_dir, "conversations", "conv_id bigint, turn bigint, role string, text string")
    writes = stream.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("seq"), F.col("role").alias("author"), F.col("text").alias("feedback"))
    run = (
        writes.writeStream.foreachBatch(J.latest_writer(f"{folder}/out", ["seq"]))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return J.read_latest(spark, f"{folder}/out").select("sample_id", "seq", "author", "feedback")


@query("st4_latest_batch", ctes=(UPSERT_SQL,), sql="SELECT sample_id, max(seq) seq FROM ups GROUP BY 1")
def st4_batch(spark, sf_dir):
    return A.latest_annotations(upserts(spark, sf_dir), ["seq"]).select("sample_id", "seq")


@query(
    "c17_progress_stream",
    ctes=(ANNOTATION_SQL,),
    sql=f"SELECT skill, key_frame, cohort, state, count(*) n FROM (SELECT *, {STATE} state FROM ann) GROUP BY 1, 2, 3, 4",
)
def c17_stream(spark, sf_dir):
    """Progress kept by the writes themselves: drafts first, then the annotations."""
    samples, saved = annotated(spark, sf_dir)
    samples, saved = settle(samples), settle(saved)
    folder = f"{scratch_folder(spark)}/progress-{uuid.uuid4().hex}"
    blank = [F.lit(None).cast(saved.schema[c].dataType).alias(c) for c in saved.columns if c != "sample_id"]
    writer = progress.progress_writer(f"{folder}/out", samples, ["seq"])
    for seq, part in enumerate((saved.where("sample_id % 3 = 0").select("sample_id", *blank), saved)):
        # A delivery is as many files as its rows have parts; the stream goes on where it stopped.
        part.withColumn("seq", F.lit(seq)).write.mode("append").parquet(f"{folder}/in")
        stream = J.read_stream(spark, f"{folder}/in", saved.withColumn("seq", F.lit(0)).schema.toDDL())
        sink = stream.writeStream.foreachBatch(writer)
        sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return progress.read_progress(spark, f"{folder}/out")
