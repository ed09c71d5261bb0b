"""Queries over point tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionlake.catalog.registry import query
from motionlake.catalog.views import TRACK_SQL, track2d
from motionlake.operators import tracks as T

SMOOTH_SQL = """
sized AS (SELECT *, count(*) OVER (PARTITION BY track_id) n FROM track),
smooth AS (
  SELECT track_id, skill, frame, n,
    (sum(x) OVER w + greatest(0, 2 - frame) * first_value(x) OVER a
      + greatest(0, frame + 2 - (n - 1)) * last_value(x) OVER a) / 5.0::DOUBLE sx,
    (sum(y) OVER w + greatest(0, 2 - frame) * first_value(y) OVER a
      + greatest(0, frame + 2 - (n - 1)) * last_value(y) OVER a) / 5.0::DOUBLE sy
  FROM sized
  WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
         a AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
vel AS (
  SELECT *, 10 * sqrt((lead(sx) OVER w - sx)**2 + (lead(sy) OVER w - sy)**2) v
  FROM smooth WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
acc AS (
  SELECT *, 10 * (lead(v) OVER (PARTITION BY track_id ORDER BY frame) - v) a FROM vel),
peak AS (
  SELECT track_id, any_value(skill) skill, CAST(max(n) AS INT) n,
         coalesce(CAST(arg_min(frame, struct_pack(o := -a, f := frame)) FILTER (a IS NOT NULL) AS INT) + 2, 0) pk
  FROM acc GROUP BY track_id),
accwin AS (
  SELECT track_id, skill, n, CAST(greatest(0, pk - 30) AS INT) s, pk, CAST(least(n - 1, pk + 30) AS INT) e FROM peak)"""


@query(
    "w01_moving_average",
    ctes=(TRACK_SQL, SMOOTH_SQL),
    sql="SELECT track_id, frame, round(sx, 6) x_smooth, round(sy, 6) y_smooth FROM smooth",
)
def w01(spark, sf_dir):
    smooth = T.moving_average(track2d(spark, sf_dir))
    return smooth.select(
        "track_id", "frame", F.round("x_smooth", 6).alias("x_smooth"), F.round("y_smooth", 6).alias("y_smooth")
    )


@query(
    "w01_moving_average_reflect",
    ctes=(
        TRACK_SQL,
        """
sized AS (SELECT *, CAST(count(*) OVER (PARTITION BY track_id) AS INT) n FROM track),
taps AS (
  SELECT track_id, frame,
         CASE WHEN frame + d < 0 THEN -(frame + d)
              WHEN frame + d > n - 1 THEN 2 * (n - 1) - (frame + d) ELSE frame + d END src
  FROM sized, (SELECT unnest([-2,-1,0,1,2]) d))""",
    ),
    sql="""SELECT t.track_id, t.frame, round(sum(s.x) / 5.0::DOUBLE, 6) x_smooth, round(sum(s.y) / 5.0::DOUBLE, 6) y_smooth
FROM taps t JOIN sized s ON s.track_id = t.track_id AND s.frame = t.src GROUP BY 1, 2""",
)
def w01_reflect(spark, sf_dir):
    smooth = T.moving_average(track2d(spark, sf_dir), pad="reflect")
    return smooth.select(
        "track_id", "frame", F.round("x_smooth", 6).alias("x_smooth"), F.round("y_smooth", 6).alias("y_smooth")
    )


@query(
    "w02_velocity",
    ctes=(TRACK_SQL,),
    sql="""SELECT track_id, frame, round(v, 6) velocity FROM (
SELECT track_id, frame, 10 * sqrt((lead(x, 2) OVER w - x)**2 + (lead(y, 2) OVER w - y)**2) / (2 * 0.5::DOUBLE) v
FROM track WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE v IS NOT NULL""",
)
def w02(spark, sf_dir):
    v = T.velocity(track2d(spark, sf_dir), dt=0.5, n=2)
    return v.withColumn("velocity", F.round("velocity", 6))


@query(
    "w03_acceleration",
    ctes=(TRACK_SQL,),
    sql="""SELECT track_id, frame, round(a, 6) acceleration FROM (
SELECT track_id, frame, 10 * (lead(v) OVER (PARTITION BY track_id ORDER BY frame) - v) a FROM (
SELECT track_id, frame, 10 * sqrt((lead(x) OVER w - x)**2 + (lead(y) OVER w - y)**2) v
FROM track WINDOW w AS (PARTITION BY track_id ORDER BY frame))) WHERE a IS NOT NULL""",
)
def w03(spark, sf_dir):
    a = T.acceleration(T.velocity(track2d(spark, sf_dir)))
    return a.withColumn("acceleration", F.round("acceleration", 6))


@query(
    "w04_peak_window",
    ctes=(TRACK_SQL, SMOOTH_SQL),
    sql='SELECT track_id, s AS start, pk AS peak, e AS "end", n FROM accwin',
)
def w04(spark, sf_dir):
    return T.peak_window(track2d(spark, sf_dir))


def _windows(spark, sf_dir):
    hand = track2d(spark, sf_dir).select("track_id", "frame", "skill", "x", "y")
    elbow = hand.select("track_id", "frame", F.col("y").alias("x"), F.col("x").alias("y"))
    return T.analysis_window(hand, elbow)


# hand = (x, y), elbow = (y, x)
WINDOW_SQL = """
pts AS (SELECT t.track_id, t.frame, t.x hx, t.y hy, t.y ex, t.x ey, a.skill, a.s, a.pk, a.e, a.n
        FROM track t JOIN accwin a USING (track_id)),
found AS (
  SELECT track_id, arg_min(frame, struct_pack(o := CASE WHEN skill IN ('clear','smash') THEN hy ELSE -hy END, f := frame))
    FILTER (frame >= s AND (CASE WHEN skill IN ('clear','smash') THEN frame <= e ELSE frame < e END)) f
  FROM pts GROUP BY track_id),
pk2 AS (SELECT a.*, coalesce(f, pk) p FROM accwin a JOIN found USING (track_id)),
ends AS (
  SELECT q.track_id, arg_min(q.frame, struct_pack(o := CASE q.skill WHEN 'serve' THEN q.ey - q.ex WHEN 'lift' THEN q.hy ELSE -q.ey END, f := q.frame))
    FILTER (q.frame >= k.p AND (q.skill = 'serve' OR q.frame <= k.e)) f
  FROM pts q JOIN pk2 k USING (track_id) GROUP BY q.track_id),
fin AS (
  SELECT k.track_id, k.skill, k.p, k.n, k.e,
         CASE WHEN coalesce(f, p) - p < 2 THEN greatest(k.e, p + 2) ELSE f END e0
  FROM pk2 k JOIN ends USING (track_id)),
win AS (
  SELECT track_id, skill, CAST(greatest(0, p - 30) AS INT) AS start, CAST(p AS INT) peak,
         CAST(CASE WHEN skill = 'lift' THEN greatest(p, least(n - 1, e0)) ELSE least(n - 1, e0) END AS INT) AS fin_end, n
  FROM fin)"""


def _window_query(name: str, condition: str) -> None:
    @query(
        name,
        ctes=(TRACK_SQL, SMOOTH_SQL, WINDOW_SQL),
        sql=f'SELECT track_id, skill, start, peak, fin_end AS "end" FROM win WHERE {condition}',
    )
    def run(spark, sf_dir):
        return _windows(spark, sf_dir).where(condition)


_window_query("w05_overhead_window", "skill IN ('clear', 'smash')")
_window_query("w06_serve_window", "skill = 'serve'")
_window_query("w07_lift_window", "skill = 'lift'")
_window_query("w08_analysis_window", "true")


@query(
    "w08_unsupported_window",
    ctes=(TRACK_SQL,),
    sql="""SELECT track_id, 'footwork' AS skill, CAST(-1 AS INT) AS start, CAST(-1 AS INT) AS peak, CAST(-1 AS INT) AS "end"
FROM track GROUP BY track_id""",
)
def w08_unsupported(spark, sf_dir):
    hand = track2d(spark, sf_dir).withColumn("skill", F.lit("footwork"))
    return T.analysis_window(hand, hand)


GAP_SQL = """
obs AS (SELECT *, (frame * 7 + track_id) % 5 > 1 ok FROM track),
edges AS (
  SELECT *, last_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER p f0,
            first_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER q f1,
            last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER p x0,
            first_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER q x1,
            last_value(CASE WHEN ok THEN y END IGNORE NULLS) OVER p y0,
            first_value(CASE WHEN ok THEN y END IGNORE NULLS) OVER q y1
  FROM obs WINDOW p AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  q AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT track_id, frame,
    round(CASE WHEN f1 > f0 THEN x0 + (x1 - x0) * ((frame - f0) / (f1 - f0)::DOUBLE) ELSE coalesce(x0, x1, 0) END, 6) x,
    round(CASE WHEN f1 > f0 THEN y0 + (y1 - y0) * ((frame - f0) / (f1 - f0)::DOUBLE) ELSE coalesce(y0, y1, 0) END, 6) y
  FROM edges)"""


def _gaps(spark, sf_dir, **kw):
    track = track2d(spark, sf_dir)
    filled = T.interpolate_gaps(track, (F.col("frame") * 7 + F.col("track_id")) % 5 > 1, **kw)
    return filled.select("track_id", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("w09_gap_interpolation", ctes=(TRACK_SQL, GAP_SQL), sql="SELECT track_id, frame, x, y FROM filled")
def w09(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(
    "w10_track_interpolation",
    ctes=(TRACK_SQL, GAP_SQL),
    sql="""SELECT track_id, frame, x, y FROM filled
WHERE track_id IN (SELECT track_id FROM obs WHERE ok GROUP BY track_id HAVING count(*) >= 40)""",
)
def w10(spark, sf_dir):
    return _gaps(spark, sf_dir, min_valid=40, empty=None)


@query(
    "w19_motion_score",
    ctes=(
        TRACK_SQL,
        """
sized AS (SELECT *, count(*) OVER (PARTITION BY track_id) n FROM track),
sm AS (SELECT track_id, frame, n,
    (sum(x) OVER w + greatest(0, 1 - frame) * first_value(x) OVER a + greatest(0, frame + 1 - (n - 1)) * last_value(x) OVER a) / 3.0::DOUBLE sx,
    (sum(y) OVER w + greatest(0, 1 - frame) * first_value(y) OVER a + greatest(0, frame + 1 - (n - 1)) * last_value(y) OVER a) / 3.0::DOUBLE sy
  FROM sized
  WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
         a AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sp AS (SELECT *, sqrt((lead(sx) OVER w - sx)**2 + (lead(sy) OVER w - sy)**2) v FROM sm WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
ga AS (SELECT *, lead(v) OVER (PARTITION BY track_id ORDER BY frame) - v g FROM sp)""",
    ),
    sql="""SELECT track_id, round(CASE WHEN max(n) < 7 THEN 0 ELSE coalesce(quantile_cont(v, 0.95) * quantile_cont(CASE WHEN g > 0 THEN g END, 0.95), 0) END, 6) motion_score
FROM ga GROUP BY track_id""",
)
def w19(spark, sf_dir):
    score = T.motion_score(track2d(spark, sf_dir))
    return score.withColumn("motion_score", F.round("motion_score", 6))


FOOT_SQL = """
feet AS (SELECT track_id, frame, x, y, 'R' side FROM track UNION ALL SELECT track_id, frame, y, x, 'L' FROM track),
fsized AS (SELECT *, count(*) OVER (PARTITION BY track_id, side) n FROM feet),
fsm AS (SELECT track_id, side, frame,
    (sum(x) OVER w + greatest(0, 2 - frame) * first_value(x) OVER a + greatest(0, frame + 2 - (n - 1)) * last_value(x) OVER a) / 5.0::DOUBLE sx,
    (sum(y) OVER w + greatest(0, 2 - frame) * first_value(y) OVER a + greatest(0, frame + 2 - (n - 1)) * last_value(y) OVER a) / 5.0::DOUBLE sy
  FROM fsized
  WINDOW w AS (PARTITION BY track_id, side ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
         a AS (PARTITION BY track_id, side ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
fv AS (SELECT *, 10 * sqrt((lead(sx) OVER w - sx)**2 + (lead(sy) OVER w - sy)**2) v FROM fsm WINDOW w AS (PARTITION BY track_id, side ORDER BY frame)),
fm AS (SELECT track_id, side, frame, v > avg(v) OVER p - stddev_pop(v) OVER p moving FROM fv WHERE v IS NOT NULL
  WINDOW p AS (PARTITION BY track_id, side)),
steps AS (SELECT track_id, frame, CAST(CASE WHEN side = 'R' THEN 0 ELSE 1 END AS INT) seq, side FROM (
  SELECT *, lag(moving) OVER (PARTITION BY track_id, side ORDER BY frame) was FROM fm) WHERE moving AND was)"""


def _steps(spark, sf_dir):
    right = track2d(spark, sf_dir).select("track_id", "frame", "x", "y")
    left = right.select("track_id", "frame", F.col("y").alias("x"), F.col("x").alias("y"))
    return T.footwork_pattern(right, left)


@query("w21_footwork_steps", ctes=(TRACK_SQL, FOOT_SQL), sql="SELECT track_id, frame, seq, side FROM steps")
def w21(spark, sf_dir):
    return _steps(spark, sf_dir)


@query(
    "w21_footwork_pattern",
    ctes=(TRACK_SQL, FOOT_SQL),
    sql="SELECT track_id, CAST(frame // 16384 AS INT) part, string_agg(side, '' ORDER BY frame, seq) pattern FROM steps GROUP BY 1, 2",
)
def w21_pattern(spark, sf_dir):
    return T.step_sequences(_steps(spark, sf_dir)).select(
        "track_id", "part", F.array_join("pattern", "").alias("pattern")
    )


@query(
    "w27_frame_intervals",
    ctes=(TRACK_SQL,),
    sql="""SELECT track_id, frame, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY track_id ORDER BY frame)) / 1e6, 6) AS "interval" FROM track""",
)
def w27(spark, sf_dir):
    gaps = T.frame_intervals(track2d(spark, sf_dir))
    return gaps.select("track_id", "frame", F.round("interval", 6).alias("interval"))


@query(
    "j11_nearest_frame",
    ctes=(
        TRACK_SQL,
        """
tracked AS (SELECT track_id, frame FROM track WHERE (frame * 7 + track_id) % 5 > 2),
lo AS (SELECT t.track_id, t.frame, r.frame lo FROM track t ASOF LEFT JOIN tracked r ON r.track_id = t.track_id AND r.frame <= t.frame),
hi AS (SELECT t.track_id, t.frame, r.frame hi FROM track t ASOF LEFT JOIN tracked r ON r.track_id = t.track_id AND r.frame >= t.frame)""",
    ),
    sql="""SELECT track_id, frame, CAST(CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo
WHEN frame - lo <= hi - frame THEN lo ELSE hi END AS INT) nearest FROM lo JOIN hi USING (track_id, frame)""",
)
def j11(spark, sf_dir):
    track = track2d(spark, sf_dir).select("track_id", "frame")
    return T.nearest_frame(track, track.where((F.col("frame") * 7 + F.col("track_id")) % 5 > 2))
