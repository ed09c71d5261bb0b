"""Queries over poses: layout, filters, geometry, normalisation, time warping."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionlake import spec
from motionlake.catalog.registry import query
from motionlake.catalog.views import (
    DETECTION_SQL,
    GRADED_SQL,
    JOINT7_SQL,
    POSE_SQL,
    TRACK_SQL,
    detections,
    graded,
    joint7,
    pose_frames,
    pose_joints,
    table,
    track2d,
)
from motionlake.operators import pose as P
from motionlake.operators import timewarp as W

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
BONES_SQL = "(VALUES " + ", ".join(f"({k},{a},{b})" for k, (a, b) in enumerate(spec.BONES)) + ") b(k, a, b)"
TRIPLETS_SQL = "(VALUES " + ", ".join(f"({k},{a},{b},{c})" for k, (a, b, c) in enumerate(spec.ANGLE_TRIPLETS)) + ") b(k, a, b, c)"
OTHER_SIDE = "CASE WHEN joint = 0 THEN joint WHEN joint % 2 = 1 THEN joint + 1 ELSE joint - 1 END"


@query(
    "s04_dense_joints",
    ctes=(JOINT7_SQL, "grid AS (SELECT DISTINCT clip_id, frame FROM joint7)"),
    sql="""SELECT g.clip_id, g.frame, CAST(j AS INT) joint, round(x, 9) x, round(y, 9) y, round(z, 9) z,
CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END conf
FROM grid g CROSS JOIN (SELECT unnest(range(0,17)) j) q LEFT JOIN joint7 p ON p.clip_id = g.clip_id AND p.frame = g.frame AND p.joint = j""",
)
def s04(spark, sf_dir):
    dense = P.dense_joints(joint7(spark, sf_dir))
    return dense.select("clip_id", "frame", "joint", *[F.round(a, 9).alias(a) for a in ("x", "y", "z")], "conf")


@query(
    "s04_repeated_joints",
    ctes=(JOINT7_SQL, "grid AS (SELECT DISTINCT clip_id, frame FROM joint7)"),
    sql="""SELECT g.clip_id, g.frame, CAST(j AS INT) joint, round(x + 0.5::DOUBLE, 9) x, round(y, 9) y, round(z, 9) z,
CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END conf
FROM grid g CROSS JOIN (SELECT unnest(range(0,17)) j) q LEFT JOIN joint7 p ON p.clip_id = g.clip_id AND p.frame = g.frame AND p.joint = j""",
)
def s04_repeated(spark, sf_dir):
    """Every observation three times; the copy with the largest coordinates counts."""
    once = joint7(spark, sf_dir)
    moved = once.withColumn("x", F.col("x") + 0.5)
    dense = P.dense_joints(once.unionByName(moved).unionByName(moved))
    return dense.select("clip_id", "frame", "joint", *[F.round(a, 9).alias(a) for a in ("x", "y", "z")], "conf")


@query(
    "p01_confidence_filter",
    ctes=(DETECTION_SQL,),
    sql="SELECT clip_id, frame, person AS joint, score, x1, y1 FROM det WHERE score > 0.5::DOUBLE AND person < 17",
)
def p01(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumnRenamed("person", "joint")
    return P.filter_confidence(rows).select("clip_id", "frame", "joint", "score", "x1", "y1")


@query(
    "p02_default_scores",
    sql="""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN [CAST(e AS DOUBLE) FOR e IN embedding[1:17]] ELSE [1.0::DOUBLE FOR i IN range(17)] END scores FROM embeddings""",
)
def p02(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scores = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 17)).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 5))
    return rows.select("vec_id", P.default_scores(scores.cast("array<double>"), F.slice("embedding", 18, 17)).alias("scores"))


@query(
    "p03_pad_depth",
    sql="""SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CASE WHEN vec_id % 2 = 0 THEN 0.0::DOUBLE ELSE CAST(embedding[3] AS DOUBLE) END] pt FROM embeddings""",
)
def p03(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    point = F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 2)).otherwise(F.slice("embedding", 1, 5))
    return rows.select("vec_id", P.pad_depth(point.cast("array<double>")).alias("pt"))


@query(
    "p04_camera_space",
    ctes=(POSE_SQL, """
cam AS (SELECT clip_id, frame, joint, -((x*100 - 960.0::DOUBLE) / 1000.0::DOUBLE * (z + 5.14388::DOUBLE)) cx, z + 5.14388::DOUBLE cy,
        -((y*100 - 540.0::DOUBLE) / 1000.0::DOUBLE * (z + 5.14388::DOUBLE)) cz FROM pose)"""),
    sql="SELECT clip_id, frame, joint, round(cx, 6) x, round(cy, 6) y, round(cz - min(cz) OVER (PARTITION BY clip_id, frame), 6) z FROM cam",
)
def p04(spark, sf_dir):
    rows = pose_joints(spark, sf_dir).withColumns({"px": F.col("x") * 100, "py": F.col("y") * 100})
    return P.to_camera(rows, 1920, 1080, 1000.0, ("clip_id", "frame")).select("clip_id", "frame", "joint", *R6("x", "y", "z"))


@query(
    "p05_retained_frames",
    ctes=(JOINT7_SQL, """
a AS (SELECT clip_id, frame FROM joint7 GROUP BY 1, 2 HAVING bool_or(joint = 1) AND bool_or(joint = 2)),
b AS (SELECT clip_id, frame FROM joint7 WHERE n = 1 GROUP BY 1, 2 HAVING bool_or(joint = 1) AND bool_or(joint = 2))"""),
    sql="""SELECT clip_id, frame source_frame, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS INT) frame
FROM a WHERE (clip_id, frame) IN (SELECT (clip_id, frame) FROM b)""",
)
def p05(spark, sf_dir):
    rows = joint7(spark, sf_dir)
    return P.retain_frames(rows, rows.where("n = 1"), (1, 2))


@query(
    "p06_source_provenance",
    ctes=(JOINT7_SQL,),
    sql="""SELECT clip_id, source_frame, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY source_frame) - 1 AS INT) frame
FROM (SELECT clip_id, frame source_frame FROM joint7 GROUP BY 1, 2 HAVING bool_or(joint = 3) AND bool_or(joint = 3 AND n = 1))""",
)
def p06(spark, sf_dir):
    rows = joint7(spark, sf_dir)
    return P.retain_frames(rows, rows.where("n = 1"), (3,))


def _remap_sql(source, dims):
    parts = ", ".join(f"CAST(embedding[{dims * s + d + 1}] AS DOUBLE)" for s in source for d in range(dims))
    return f"SELECT vec_id, [{parts}] p FROM embeddings"


@query("p07_remap_h36m", sql=_remap_sql(spec.H36M_SOURCE, 3))
def p07_h36m(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return P.remap_topology(rows, spec.H36M_SOURCE)


@query("p07_remap_mediapipe", sql=_remap_sql(spec.MEDIAPIPE_SOURCE, 2))
def p07_mediapipe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    return P.remap_topology(rows, spec.MEDIAPIPE_SOURCE, dims=2)


@query(
    "p08_mirror_left_right",
    ctes=(POSE_SQL,),
    sql=f"SELECT clip_id, frame, CAST(CASE WHEN handedness = 'left' THEN {OTHER_SIDE} ELSE joint END AS INT) joint, x, y, z, conf FROM pose",
)
def p08(spark, sf_dir):
    return P.mirror_left_right(pose_joints(spark, sf_dir)).select("clip_id", "frame", "joint", "x", "y", "z", "conf")


@query(
    "p26_physical_side",
    ctes=(POSE_SQL,),
    sql="SELECT clip_id, frame, joint, x, y, z, conf FROM pose",
)
def p26(spark, sf_dir):
    canonical = P.mirror_left_right(pose_joints(spark, sf_dir))
    return P.mirror_left_right(canonical).select("clip_id", "frame", "joint", "x", "y", "z", "conf")


@query(
    "p09_resolve_handedness",
    ctes=(GRADED_SQL,),
    sql="""SELECT clip_id, CASE WHEN clip_id % 11 = 0 THEN 'left' WHEN clip_id % 7 = 0 THEN 'right' WHEN clip_id % 3 = 0 THEN handedness WHEN clip_id % 2 = 0 THEN 'left' ELSE 'right' END handedness,
CASE WHEN clip_id % 11 = 0 THEN 'known_metadata' WHEN clip_id % 7 = 0 THEN 'metadata_override' WHEN clip_id % 3 = 0 THEN 'wrist_motion' ELSE 'filename_fallback' END handedness_source FROM graded""",
)
def p09(spark, sf_dir):
    rows = graded(spark, sf_dir)
    key = F.col("clip_id")
    hand, source = P.resolve_handedness(
        F.when(key % 11 == 0, "left"),
        F.when(key % 7 == 0, "right"),
        F.when(key % 3 == 0, F.col("handedness")),
        F.when(key % 2 == 0, "My_LEFT_clip.mp4").otherwise("clip.mp4"),
    )
    return rows.select("clip_id", hand.alias("handedness"), source.alias("handedness_source"))


@query(
    "p10_strict_handedness",
    ctes=(GRADED_SQL,),
    sql="""SELECT clip_id, CASE WHEN clip_id % 2 = 0 THEN 'left' WHEN clip_id % 5 > 0 THEN handedness END handedness,
CASE WHEN clip_id % 2 = 1 AND clip_id % 5 = 0 THEN 'handedness is ambiguous; rerun with right or left' ELSE '' END error FROM graded""",
)
def p10(spark, sf_dir):
    key = F.col("clip_id")
    hand, error = P.strict_handedness(
        F.when(key % 2 == 0, "left").otherwise("auto"), F.when(key % 5 > 0, F.col("handedness"))
    )
    return graded(spark, sf_dir).select("clip_id", hand.alias("handedness"), error.alias("error"))


@query(
    "p11_sequence_identity",
    ctes=(GRADED_SQL,),
    sql="SELECT clip_id, 'b_clip_' || clip_id sequence_id, 'b_clip_' || clip_id || '.mp4' video_name FROM graded",
)
def p11(spark, sf_dir):
    from motionlake.functions.columns import file_stem, file_suffix

    path = F.concat(F.lit("/a/b.c/clip_"), F.col("clip_id").cast("string"), F.lit(".MP4"))
    stem, name = P.sequence_identity(file_stem(path), file_suffix(path), "b_")
    return graded(spark, sf_dir).select("clip_id", stem.alias("sequence_id"), name.alias("video_name"))


@query(
    "p12_clamp_window",
    ctes=("w AS (SELECT o_orderkey clip_id, o_orderkey % 40 n, o_orderkey % 13 - 2 s, o_orderkey % 29 p, o_orderkey % 47 e FROM orders)",
          "c1 AS (SELECT *, greatest(0, least(n - 1, s)) s1 FROM w)", "c2 AS (SELECT *, greatest(s1, least(n - 1, p)) p1 FROM c1)",
          "c3 AS (SELECT *, greatest(p1, least(n - 1, e)) e1 FROM c2)"),
    sql="""SELECT clip_id, CAST(s1 AS INT) AS start, CAST(p1 AS INT) peak, CAST(e1 AS INT) AS "end",
CASE WHEN n < 5 THEN 'fewer than five tracked frames' WHEN e1 - s1 < 4 THEN 'analysis window is too short' ELSE '' END error FROM c3""",
)
def p12(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("clip_id"), (k % 40).alias("n"), (k % 13 - 2).alias("start"), (k % 29).alias("peak"), (k % 47).alias("end")
    )
    return W.clamp_window(rows).drop("n")


@query(
    "p13_critical_joints",
    ctes=(POSE_SQL, "m AS (SELECT clip_id, frame, joint FROM pose WHERE joint IN (5,6,11,12) GROUP BY ALL HAVING max(conf) = 0)"),
    sql="SELECT clip_id, frame, CAST(min(joint) AS INT) missing_joint FROM m GROUP BY 1, 2",
)
def p13(spark, sf_dir):
    return P.missing_torso(pose_joints(spark, sf_dir), ("clip_id", "frame"))


@query(
    "p14_missing_joint_ratio",
    ctes=(POSE_SQL,),
    sql="SELECT clip_id, round(1 - avg(conf), 6) missing_joint_ratio FROM pose GROUP BY 1",
)
def p14(spark, sf_dir):
    return P.missing_joint_ratio(pose_joints(spark, sf_dir)).select("clip_id", *R6("missing_joint_ratio"))


ANCHOR_SQL = """
win AS (SELECT o_orderkey clip_id, CAST(o_orderkey % 13 AS INT) s, CAST(o_orderkey % 13 + o_orderkey % 17 AS INT) p,
        CAST(o_orderkey % 13 + o_orderkey % 17 + o_orderkey % 19 + 1 AS INT) e, o_orderkey % 4 k FROM orders),
anch AS (SELECT clip_id, k, [CAST(round_even((r - s) * 63 / (e - s)::DOUBLE, 0) AS INT) FOR r IN [s, (s+p)//2, p, (p+e)//2, e]] anchors FROM win)"""


def _anchors(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("clip_id"),
        (k % 13).alias("s"),
        (k % 13 + k % 17).alias("p"),
        (k % 13 + k % 17 + k % 19 + 1).alias("e"),
        F.element_at(F.array(*[F.lit(n) for n in spec.SKILLS]), (k % 4 + 1).cast("int")).alias("skill"),
    )
    return rows.select("clip_id", "skill", W.phase_anchors(F.col("s"), F.col("p"), F.col("e")).alias("anchors"))


@query("w14_phase_anchors", ctes=(ANCHOR_SQL,), sql="SELECT clip_id, anchors FROM anch")
def w14(spark, sf_dir):
    return _anchors(spark, sf_dir).drop("skill")


@query(
    "p15_anchor_order",
    ctes=(ANCHOR_SQL,),
    sql="""SELECT clip_id, 'phase anchors are not strictly increasing' error FROM anch
WHERE NOT (anchors[1] < anchors[2] AND anchors[2] < anchors[3] AND anchors[3] < anchors[4] AND anchors[4] < anchors[5])""",
)
def p15(spark, sf_dir):
    return W.anchor_errors(_anchors(spark, sf_dir))


SOURCE_SQL = """
src AS (SELECT o_orderkey clip_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL
        ELSE [CAST(i * (o_orderkey % 3) - CASE WHEN o_orderkey % 7 = 0 THEN i * i ELSE 0 END + o_orderkey % 2 AS INT) FOR i IN range(64)] END si FROM orders)"""


def _source_frames(spark, sf_dir):
    k = F.col("o_orderkey")
    dip = F.when(k % 7 == 0, 1).otherwise(0)
    arr = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * (k % 3) - dip * i * i + k % 2).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("clip_id"), F.when(k % 5 != 0, arr).alias("source_frame_indices")
    )


@query(
    "p16_source_index_validity",
    ctes=(SOURCE_SQL,),
    sql="""SELECT clip_id, len([1 FOR i IN range(1, 64) IF v[i+1] < v[i]]) = 0 AND list_min(v) >= 0 valid, CAST(v[64] AS INT) last_source
FROM (SELECT clip_id, coalesce(si, [CAST(i AS INT) FOR i IN range(64)]) v FROM src)""",
)
def p16(spark, sf_dir):
    rows = _source_frames(spark, sf_dir).withColumn("v", W.source_frames_or_default(F.col("source_frame_indices")))
    return rows.select("clip_id", W.valid_source_frames(F.col("v")).alias("valid"), F.get("v", 63).alias("last_source"))


# --- geometry ---------------------------------------------------------------------

BODY_SQL = f"""
bone AS (SELECT a0.clip_id, a0.frame, b.k bone, sqrt((a0.x-b0.x)**2 + (a0.y-b0.y)**2 + (a0.z-b0.z)**2) len, a0.conf > 0 AND b0.conf > 0 obs
         FROM {BONES_SQL} JOIN pose a0 ON a0.joint = b.a JOIN pose b0 ON b0.joint = b.b AND b0.clip_id = a0.clip_id AND b0.frame = a0.frame)"""


@query("j06_bone_lengths", ctes=(POSE_SQL, BODY_SQL), sql="SELECT clip_id, frame, CAST(bone AS INT) bone, round(len, 6) length, obs observed FROM bone")
def j06(spark, sf_dir):
    return P.bone_lengths(pose_frames(spark, sf_dir)).select("clip_id", "frame", "bone", *R6("length"), "observed")


@query(
    "a12_body_scale",
    ctes=(POSE_SQL, BODY_SQL),
    sql="SELECT clip_id, round(coalesce(median(CASE WHEN obs AND len > 1e-8 THEN len END), 1), 6) scale FROM bone GROUP BY clip_id",
)
def a12(spark, sf_dir):
    return P.body_scale(pose_frames(spark, sf_dir)).select("clip_id", *R6("scale"))


def _angle_sql(a, b, c):
    dot = "+".join(f"(p{a}.{d}-p{b}.{d})*(p{c}.{d}-p{b}.{d})" for d in "xyz")
    return dot


NAMED_SQL = (
    "na AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}',{a},{b},{c})" for n, (a, b, c) in spec.NAMED_ANGLES.items())
    + ") q(name, a, b, c)), ang AS (SELECT p1.clip_id, p1.frame, na.name,"
    " (p1.x-p2.x)*(p3.x-p2.x)+(p1.y-p2.y)*(p3.y-p2.y)+(p1.z-p2.z)*(p3.z-p2.z) dot,"
    " sqrt((p1.x-p2.x)**2+(p1.y-p2.y)**2+(p1.z-p2.z)**2) * sqrt((p3.x-p2.x)**2+(p3.y-p2.y)**2+(p3.z-p2.z)**2) size,"
    " p1.conf*p2.conf*p3.conf ok FROM na JOIN pose p1 ON p1.joint = a JOIN pose p2 ON p2.joint = b AND p2.clip_id = p1.clip_id AND p2.frame = p1.frame"
    " JOIN pose p3 ON p3.joint = c AND p3.clip_id = p1.clip_id AND p3.frame = p1.frame),"
    " angd AS (SELECT clip_id, frame, name, round(CASE WHEN size > 0 AND ok > 0 THEN degrees(acos(greatest(-1, least(1, dot / size)))) ELSE 0 END, 6) deg FROM ang)"
)


@query("x04_named_angles", ctes=(POSE_SQL, NAMED_SQL), sql="SELECT clip_id, frame, name, deg AS degrees FROM angd")
def x04(spark, sf_dir):
    angles = P.named_angles(pose_frames(spark, sf_dir)).select("clip_id", "frame", F.explode("angles").alias("name", "degrees"))
    return angles.select("clip_id", "frame", "name", *R6("degrees"))


@query(
    "x05_mirror_angles",
    ctes=(POSE_SQL, NAMED_SQL),
    sql="""SELECT clip_id, frame, CASE WHEN name LIKE '%Left%' THEN replace(name, 'Left', 'Right') ELSE replace(name, 'Right', 'Left') END AS name, deg AS degrees FROM angd""",
)
def x05(spark, sf_dir):
    rows = P.named_angles(pose_frames(spark, sf_dir))
    mirrored = rows.select("clip_id", "frame", F.explode(P.mirror_angle_names(F.col("angles"))).alias("name", "degrees"))
    return mirrored.select("clip_id", "frame", "name", *R6("degrees"))


@query(
    "x06_torso_lean",
    ctes=(POSE_SQL, "w AS (SELECT clip_id, frame, sum(CASE WHEN joint IN (5,6) THEN y WHEN joint IN (11,12) THEN -y END) * 0.5::DOUBLE dy, sum(CASE WHEN joint IN (5,6) THEN z WHEN joint IN (11,12) THEN -z END) * 0.5::DOUBLE dz FROM pose GROUP BY 1, 2)"),
    sql="SELECT clip_id, frame, round(atan2(dz, dy), 6) lean FROM w",
)
def x06(spark, sf_dir):
    return P.torso_lean(pose_frames(spark, sf_dir)).select("clip_id", "frame", *R6("lean"))


@query(
    "a26_keypoint_boxes",
    ctes=(POSE_SQL,),
    sql="SELECT clip_id, frame, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pose GROUP BY 1, 2",
)
def a26(spark, sf_dir):
    return P.boxes_from_keypoints(pose_joints(spark, sf_dir), ("clip_id", "frame"))


@query(
    "t13_largest_person",
    ctes=(DETECTION_SQL,),
    sql="""SELECT clip_id, frame, person, l_partkey, l_suppkey, area FROM (SELECT *, greatest(0, x1-x0)*greatest(0, y1-y0) area,
row_number() OVER (PARTITION BY clip_id, frame ORDER BY greatest(0, x1-x0)*greatest(0, y1-y0) DESC, person, l_partkey, l_suppkey) rn FROM det) WHERE rn = 1""",
)
def t13(spark, sf_dir):
    best = P.largest_person(detections(spark, sf_dir), order=("person", "l_partkey", "l_suppkey"))
    return best.select("clip_id", "frame", "person", "l_partkey", "l_suppkey", "area")


@query(
    "j04_confidence_merge",
    ctes=(POSE_SQL,),
    sql="SELECT a.clip_id, a.frame, a.joint, a.x, least(a.conf, b.conf) conf FROM pose a JOIN pose b ON b.clip_id = a.clip_id AND b.frame = (a.frame + 1) AND b.joint = a.joint",
)
def j04(spark, sf_dir):
    a = pose_joints(spark, sf_dir)
    b = a.withColumn("frame", F.col("frame") - 1)
    return P.merge_confidence(a, b).select("clip_id", "frame", "joint", "x", "conf")


FILL_SQL = """
pe AS (SELECT *, last_value(CASE WHEN conf > 0 THEN frame END IGNORE NULLS) OVER p f0, first_value(CASE WHEN conf > 0 THEN frame END IGNORE NULLS) OVER q f1,
  last_value(CASE WHEN conf > 0 THEN x END IGNORE NULLS) OVER p x0, first_value(CASE WHEN conf > 0 THEN x END IGNORE NULLS) OVER q x1,
  last_value(CASE WHEN conf > 0 THEN y END IGNORE NULLS) OVER p y0, first_value(CASE WHEN conf > 0 THEN y END IGNORE NULLS) OVER q y1,
  last_value(CASE WHEN conf > 0 THEN z END IGNORE NULLS) OVER p z0, first_value(CASE WHEN conf > 0 THEN z END IGNORE NULLS) OVER q z1
  FROM pose WINDOW p AS (PARTITION BY clip_id, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   q AS (PARTITION BY clip_id, joint ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fil AS (SELECT clip_id, frame, joint, conf, handedness, skill, label,
  CASE WHEN f1 > f0 THEN x0 + (x1 - x0) * ((frame - f0) / (f1 - f0)::DOUBLE) ELSE coalesce(x0, x1, 0) END x,
  CASE WHEN f1 > f0 THEN y0 + (y1 - y0) * ((frame - f0) / (f1 - f0)::DOUBLE) ELSE coalesce(y0, y1, 0) END y,
  CASE WHEN f1 > f0 THEN z0 + (z1 - z0) * ((frame - f0) / (f1 - f0)::DOUBLE) ELSE coalesce(z0, z1, 0) END z FROM pe)"""


@query("w09_pose_interpolation", ctes=(POSE_SQL, FILL_SQL), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, conf FROM fil")
def w09_pose(spark, sf_dir):
    return P.fill_joints(pose_joints(spark, sf_dir)).select("clip_id", "frame", "joint", *R6("x", "y", "z"), "conf")


def _norm_sql(search: bool) -> str:
    pick = "arg_min(ax, frame) FILTER (w >= 1e-8 AND h >= 1e-8)" if search else "arg_min(ax, frame)"
    return f"""
can AS (SELECT clip_id, frame, CASE WHEN handedness = 'left' THEN {OTHER_SIDE} ELSE joint END joint, x, y, z, conf, handedness FROM fil),
wide AS (SELECT clip_id, frame, """ + ", ".join(
        f"max(CASE WHEN joint = {j} THEN {d} END) {d}{j}" for j in (5, 6, 11, 12) for d in "xyz"
    ) + """ FROM can GROUP BY 1, 2),
b1 AS (SELECT *, sqrt((x6-x5)**2+(y6-y5)**2+(z6-z5)**2) w, (x11+x12)/2 rx, (y11+y12)/2 ry, (z11+z12)/2 rz FROM wide),
b2 AS (SELECT *, (x6-x5)/w ux, (y6-y5)/w uy, (z6-z5)/w uz, (x5+x6)/2-rx sx, (y5+y6)/2-ry sy, (z5+z6)/2-rz sz FROM b1),
b3 AS (SELECT *, sx*ux+sy*uy+sz*uz dt FROM b2),
b4 AS (SELECT *, sx-dt*ux tx, sy-dt*uy ty, sz-dt*uz tz FROM b3),
b5 AS (SELECT *, sqrt(tx**2+ty**2+tz**2) h FROM b4),
b6 AS (SELECT *, [ux,uy,uz,tx/h,ty/h,tz/h, uy*tz/h-uz*ty/h, uz*tx/h-ux*tz/h, ux*ty/h-uy*tx/h] ax FROM b5),
bas AS (SELECT clip_id, """ + pick + """ ax FROM b6 GROUP BY 1),
scl AS (SELECT a0.clip_id, coalesce(median(CASE WHEN a0.conf > 0 AND b0.conf > 0 AND l > 1e-8 THEN l END), 1) scale FROM (
  SELECT a0.*, b0.conf bconf, sqrt((a0.x-b0.x)**2+(a0.y-b0.y)**2+(a0.z-b0.z)**2) l FROM """ + BONES_SQL + """ JOIN can a0 ON a0.joint = b.a JOIN can b0 ON b0.joint = b.b AND b0.clip_id = a0.clip_id AND b0.frame = a0.frame) a0, (SELECT 1) q(u), LATERAL (SELECT a0.bconf conf) b0 GROUP BY 1),
nrm AS (SELECT c.clip_id, c.frame, CAST(c.joint AS INT) joint, c.conf,
  (ax[1]*(x-rx)+ax[2]*(y-ry)+ax[3]*(z-rz))/scale x, (ax[4]*(x-rx)+ax[5]*(y-ry)+ax[6]*(z-rz))/scale y,
  CASE WHEN handedness = 'left' THEN -1 ELSE 1 END * (ax[7]*(x-rx)+ax[8]*(y-ry)+ax[9]*(z-rz))/scale z
  FROM can c JOIN b1 USING (clip_id, frame) JOIN bas USING (clip_id) JOIN scl USING (clip_id))"""


@query("w16_normalize_pose", ctes=(POSE_SQL, FILL_SQL, _norm_sql(True)), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, conf FROM nrm")
def w16(spark, sf_dir):
    out = P.unpack(P.normalize_pose(pose_joints(spark, sf_dir)))
    return out.select("clip_id", "frame", "joint", *R6("x", "y", "z"), "conf")


@query("w17_normalize_first_frame", ctes=(POSE_SQL, FILL_SQL, _norm_sql(False)), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, conf FROM nrm")
def w17(spark, sf_dir):
    out = P.unpack(P.normalize_pose(pose_joints(spark, sf_dir), basis="first"))
    return out.select("clip_id", "frame", "joint", *R6("x", "y", "z"), "conf")


# --- time warping -----------------------------------------------------------------

RESAMPLE_SQL = """
nn AS (SELECT clip_id, max(frame) + 1 n FROM pose GROUP BY 1),
rs AS (SELECT a.clip_id, CAST(g AS INT) frame, a.joint, a.skill, a.label, a.handedness,
    a.x + (coalesce(b.x, a.x) - a.x) * (g * (n-1) / 63.0::DOUBLE - a.frame) x,
    a.y + (coalesce(b.y, a.y) - a.y) * (g * (n-1) / 63.0::DOUBLE - a.frame) y,
    a.z + (coalesce(b.z, a.z) - a.z) * (g * (n-1) / 63.0::DOUBLE - a.frame) z,
    a.conf + (coalesce(b.conf, a.conf) - a.conf) * (g * (n-1) / 63.0::DOUBLE - a.frame) conf
  FROM nn CROSS JOIN (SELECT unnest(range(0, 64)) g) q JOIN pose a ON a.clip_id = nn.clip_id AND a.frame = (g * (n-1)) // 63
  LEFT JOIN pose b ON b.clip_id = a.clip_id AND b.joint = a.joint AND b.frame = a.frame + 1)"""


def clips64(spark, sf_dir):
    return W.resample(pose_frames(spark, sf_dir))


@query("w11_resample", ctes=(POSE_SQL, RESAMPLE_SQL), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, round(conf,6) conf FROM rs")
def w11(spark, sf_dir):
    return P.unpack(clips64(spark, sf_dir)).select("clip_id", "frame", "joint", *R6("x", "y", "z", "conf"))


# anchors of the 64-frame clips, from their id
CLIP_ANCHOR_SQL = """
ca AS (SELECT DISTINCT clip_id, [clip_id % 3, 12 + clip_id % 9, 30 + clip_id % 7, 45 + clip_id % 8, 62 + clip_id % 2] anc FROM pose)"""
ANCHOR_EXPR = "array(clip_id % 3, 12 + clip_id % 9, 30 + clip_id % 7, 45 + clip_id % 8, 62 + clip_id % 2)"


def aligned(spark, sf_dir):
    return W.phase_align(clips64(spark, sf_dir).withColumn("anchors", F.expr(ANCHOR_EXPR)))


def _knots_sql(source: str, target: str) -> str:
    """Position of every frame g when knots target land on knots source (clamped)."""
    s = [f"{source}[{i}]" for i in range(1, 6)]
    t = [f"{target}[{i}]" for i in range(1, 6)]
    cases = f"WHEN g <= {t[0]} THEN {s[0]} "
    for i in range(4):
        cases += f"WHEN g < {t[i+1]} THEN {s[i]} + (g - {t[i]}) * ({s[i+1]} - {s[i]}) / ({t[i+1]} - {t[i]})::DOUBLE "
    return f"CASE {cases} ELSE {s[4]} END"


def _warp_sql(name: str, base: str, source: str, target: str) -> str:
    return f"""
{name}_pos AS (SELECT clip_id, g, {_knots_sql(source, target)} pos FROM ca, (SELECT unnest(range(0, 64)) g) q),
{name} AS (SELECT a.clip_id, CAST(g AS INT) frame, a.joint, a.skill, a.label, a.handedness,
   a.x + (coalesce(b.x, a.x) - a.x) * (pos - a.frame) x, a.y + (coalesce(b.y, a.y) - a.y) * (pos - a.frame) y,
   a.z + (coalesce(b.z, a.z) - a.z) * (pos - a.frame) z, a.conf + (coalesce(b.conf, a.conf) - a.conf) * (pos - a.frame) conf
  FROM {name}_pos JOIN {base} a ON a.clip_id = {name}_pos.clip_id AND a.frame = CAST(floor(pos) AS INT)
  LEFT JOIN {base} b ON b.clip_id = a.clip_id AND b.joint = a.joint AND b.frame = a.frame + 1)"""


CANON = "[0, 16, 32, 48, 63]"
ALIGN_SQL = _warp_sql("al", "rs", "anc", CANON)


@query("w12_phase_align", ctes=(POSE_SQL, RESAMPLE_SQL, CLIP_ANCHOR_SQL, ALIGN_SQL), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, round(conf,6) conf FROM al")
def w12(spark, sf_dir):
    return P.unpack(aligned(spark, sf_dir)).select("clip_id", "frame", "joint", *R6("x", "y", "z", "conf"))


@query("w13_restore_timing", ctes=(POSE_SQL, RESAMPLE_SQL, CLIP_ANCHOR_SQL, _warp_sql("re", "rs", CANON, "anc")), sql="SELECT clip_id, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z FROM re")
def w13(spark, sf_dir):
    rows = W.restore_timing(clips64(spark, sf_dir).withColumn("anchors", F.expr(ANCHOR_EXPR)))
    return P.unpack(rows).select("clip_id", "frame", "joint", *R6("x", "y", "z"))


@query(
    "w15_source_frame_map",
    ctes=(TRACK_SQL, "n AS (SELECT track_id, max(frame) + 1 n FROM track GROUP BY 1)"),
    sql="""SELECT track_id, CAST(g AS INT) frame, CAST(round_even(a.frame * 3 + (coalesce(b.frame, a.frame) * 3 - a.frame * 3) * (g * (n-1) / 63.0::DOUBLE - a.frame), 0) AS BIGINT) source_frame
FROM n CROSS JOIN (SELECT unnest(range(0,64)) g) q JOIN track a USING (track_id) LEFT JOIN track b ON b.track_id = a.track_id AND b.frame = a.frame + 1 WHERE a.frame = (g * (n-1)) // 63""",
)
def w15(spark, sf_dir):
    rows = track2d(spark, sf_dir).select("track_id", "frame", (F.col("frame") * 3.0).alias("at"))
    out = W.resample(rows, values=("at",), key="track_id")
    return out.select("track_id", "frame", F.rint("at").cast("bigint").alias("source_frame"))


# --- phases and key frames --------------------------------------------------------

PHASE_SQL = """
fr AS (SELECT clip_id, (['serve','lift','clear','smash'])[CAST(k AS INT) + 1] skill, anchors a, CAST(clip_id * 7 % 64 AS INT) frame FROM anch)"""
PHASE_CASE = """CASE skill WHEN 'lift' THEN CASE WHEN frame < a[2] THEN 'preparation' WHEN frame < a[4] THEN 'backswing' WHEN frame <= a[4] THEN 'contact' ELSE 'follow_through' END
WHEN 'serve' THEN CASE WHEN frame <= a[2] THEN 'preparation' WHEN frame < a[4] THEN 'weight_transfer' WHEN frame <= a[4] THEN 'contact' ELSE 'follow_through' END
ELSE CASE WHEN frame < a[2] THEN 'preparation' WHEN frame < a[3] THEN 'rotation' WHEN frame <= a[3] THEN 'contact' ELSE 'follow_through' END END"""
ROLE_CASE = "CASE skill " + " ".join(
    f"WHEN '{s}' THEN CASE " + " ".join(f"WHEN frame = a[{i + 1}] THEN '{spec.CHECKPOINT_ROLES[s][i]}'" for i in (4, 3, 2, 1, 0)) + f" ELSE '{spec.BETWEEN_ANCHORS}' END"
    for s in spec.SKILLS
) + " END"


@query("w23_phase_of_frame", ctes=(ANCHOR_SQL, PHASE_SQL), sql=f"SELECT clip_id, skill, frame, {PHASE_CASE} phase FROM fr")
def w23(spark, sf_dir):
    rows = _anchors(spark, sf_dir).withColumn("frame", (F.col("clip_id") * 7 % 64).cast("int"))
    return rows.select("clip_id", "skill", "frame", W.phase_of_frame(F.col("frame"), F.col("anchors"), F.col("skill")).alias("phase"))


@query("w24_checkpoint_role", ctes=(ANCHOR_SQL, PHASE_SQL), sql=f"SELECT clip_id, skill, frame, {ROLE_CASE} role FROM fr")
def w24(spark, sf_dir):
    rows = _anchors(spark, sf_dir).withColumn("frame", (F.col("clip_id") * 7 % 64).cast("int"))
    return rows.select("clip_id", "skill", "frame", W.checkpoint_role(F.col("frame"), F.col("anchors"), F.col("skill")).alias("role"))


PLAN_SQL = """
cand AS (SELECT clip_id, skill, a, unnest(list_distinct([a[1], a[2], a[3], a[4], a[5], (a[1]+a[2])//2, (a[2]+a[3])//2, (a[3]+a[4])//2, (a[4]+a[5])//2,
   greatest(a[2], a[3]-3), least(a[4], a[3]+3)])) frame FROM fr)"""


@query(
    "w25_keyframe_plan",
    ctes=(ANCHOR_SQL, PHASE_SQL, PLAN_SQL),
    sql=f"""SELECT clip_id, skill, CAST(frame AS INT) frame, CAST(frame * 2 AS INT) source_frame, round(frame * 2 / (CASE WHEN clip_id % 6 = 0 THEN 30.0::DOUBLE ELSE 25.0::DOUBLE END), 6) timestamp_seconds,
{PHASE_CASE} phase, {ROLE_CASE} role FROM cand""",
)
def w25(spark, sf_dir):
    rows = _anchors(spark, sf_dir).withColumns(
        {
            "fps": F.when(F.col("clip_id") % 6 == 0, 0.0).otherwise(25.0),
            "source_frame_indices": F.array(*[F.lit(2 * i) for i in range(64)]),
        }
    )
    return W.keyframe_plan(rows).withColumn("timestamp_seconds", F.round("timestamp_seconds", 6))


@query(
    "w30_pause_timeline",
    ctes=("g AS (SELECT o_orderkey clip_id, unnest(range(0,64)) frame FROM orders)",
          "pr AS (SELECT l_orderkey clip_id, l_linenumber * 9 frame, count(*) issues FROM lineitem WHERE l_linenumber * 9 < 64 GROUP BY 1, 2)"),
    sql="""SELECT clip_id, CAST(frame AS INT) frame, CAST(r AS INT) "repeat", issues FROM (
SELECT g.clip_id, g.frame, coalesce(issues, 0) issues, unnest(range(0, CASE WHEN issues IS NULL THEN 1 ELSE 1 + CAST(round_even(25 * 0.1, 0) AS INT) END)) r FROM g LEFT JOIN pr ON pr.clip_id = g.clip_id AND pr.frame = g.frame)""",
)
def w30(spark, sf_dir):
    problems = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.col("l_linenumber") * 9).alias("frame"))
    clips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"))
    return W.pause_timeline(problems, clips, F.lit(25.0), 0.1)
