"""The four motion contracts (skills) and the skeleton, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.session import inline_table

# ---------------------------------------------------------------------------------
# Fixed values. They decide the results and must stay exactly as they are.

SKILLS = ("serve", "lift", "clear", "smash")

JOINTS = 17
CANONICAL_ANCHORS = (0, 16, 32, 48, 63)
CLIP_FRAMES = 64

# (left, right) joint slots exchanged for left-handed clips
LEFT_RIGHT_PAIRS = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))

# bones in the order the bone-length relaxation visits them
BONES = (
    (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11),
    (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16),
)

# joint angle at the middle joint of each triplet
ANGLE_TRIPLETS = (
    (5, 7, 9), (6, 8, 10), (7, 5, 11), (8, 6, 12),
    (5, 11, 13), (6, 12, 14), (11, 13, 15), (12, 14, 16),
)

COMPONENT_WEIGHTS = {"position": 1.0, "angle": 0.5, "velocity": 0.5, "bone_length": 0.25}
TRAINING_WEIGHTS = {"position": 1.0, "angle": 0.25, "velocity": 0.5, "bone_length": 1.0}

JOINT_NAMES = {
    0: "head",
    5: "non_dominant_shoulder", 6: "dominant_shoulder",
    7: "non_dominant_elbow", 8: "dominant_elbow",
    9: "non_dominant_wrist", 10: "dominant_wrist",
    11: "non_dominant_hip", 12: "dominant_hip",
    13: "non_dominant_knee", 14: "dominant_knee",
    15: "non_dominant_ankle", 16: "dominant_ankle",
}

NAMED_ANGLES = {
    "Left Elbow Angle": (5, 7, 9),
    "Right Elbow Angle": (6, 8, 10),
    "Left Knee Angle": (11, 13, 15),
    "Right Knee Angle": (12, 14, 16),
    "Left Shoulder Angle": (11, 5, 7),
    "Right Shoulder Angle": (12, 6, 8),
    "Left Crotch Angle": (13, 11, 12),
    "Right Crotch Angle": (14, 12, 11),
    "Nose Right Shoulder Elbow Angle": (0, 6, 8),
    "Nose Left Shoulder Elbow Angle": (0, 5, 7),
}

JOINT_WEIGHTS = {
    "serve": (0.5, 0.25, 0.25, 0.25, 0.25, 1.75, 2.0, 1.5, 2.5, 1.5, 3.0,
              2.5, 2.5, 2.0, 2.0, 2.0, 2.0),
    "lift": (0.5, 0.25, 0.25, 0.25, 0.25, 1.25, 2.5, 1.0, 3.5, 1.0, 4.5,
             1.25, 1.5, 1.0, 1.25, 1.0, 1.25),
    "clear": (0.5, 0.25, 0.25, 0.25, 0.25, 1.5, 2.0, 1.25, 3.0, 1.5, 4.0,
              1.5, 1.5, 1.25, 1.25, 1.25, 1.25),
    "smash": (0.5, 0.25, 0.25, 0.25, 0.25, 1.5, 2.5, 1.25, 3.5, 1.25, 4.5,
              2.0, 2.0, 1.5, 1.5, 1.25, 1.25),
}

# full-body transition term; only serve uses it
TRANSITION_WEIGHT = {"serve": 1.0, "lift": 0.0, "clear": 0.0, "smash": 0.0}
TRANSITION_JOINTS = (11, 12, 13, 14, 15, 16)
LEAN_JOINTS = (5, 6, 11, 12)

# (name, start, end) half-open on the 64-frame clip, overlapping
PHASE_WINDOWS = {
    "serve": (("preparation", 0, 24), ("weight_transfer", 16, 48),
              ("contact", 36, 56), ("follow_through", 48, 64)),
    "lift": (("preparation", 0, 20), ("backswing", 12, 40),
             ("contact", 36, 56), ("follow_through", 48, 64)),
    "clear": (("preparation", 0, 16), ("rotation", 8, 32),
              ("contact", 27, 38), ("follow_through", 38, 64)),
    "smash": (("preparation", 0, 16), ("rotation", 8, 32),
              ("contact", 27, 38), ("follow_through", 38, 64)),
}

# rule id, criterion name, phase, maximum, measured joints, coaching joints,
# allowed anchor positions, window start, window end, window joints (None = all, weighted)
_UPPER = (5, 6, 7, 8, 9, 10)
_LOWER = (11, 12, 13, 14, 15, 16)
_ARM = (6, 8, 10)
_TORSO = (5, 6, 11, 12)
_TORSO_LEGS = (5, 6, 11, 12, 13, 14, 15, 16)
_TORSO_ARM = (5, 6, 8, 10, 11, 12)

RULES = {
    "serve": (
        ("arms_raised", "雙手平舉", "preparation", 10.0, _UPPER, (7, 8), (1,), 8, 32, _UPPER),
        ("racket_foot_weight", "將重心放至持拍腳", "preparation", 10.0,
         _LOWER, (12, 14, 16), (1,), 8, 32, _LOWER),
        ("weight_transfer", "重心轉移至非持拍腳", "weight_transfer", 20.0,
         _TORSO_LEGS, (5, 6, 11, 12, 15, 16), (2,), 0, 64, _LOWER),
        ("hip_rotation", "髖關節前旋", "follow_through", 20.0, _TORSO, (11, 12), (4,), 16, 64, _TORSO),
        ("wrist_flick", "持拍手手腕發力", "contact", 20.0, _ARM, (8, 10), (3,), 36, 56, _ARM),
        ("shoulder_rotation", "肩膀旋轉朝前", "follow_through", 20.0,
         _TORSO_ARM, (6,), (4,), 48, 64, _TORSO_ARM),
    ),
    "lift": (
        ("preparation", "手腕放置腰部放鬆預備", "preparation", 10.0, _UPPER, _ARM, (0,), 0, 20, _UPPER),
        ("backswing", "手腕往後引拍", "backswing", 25.0, _ARM, (8, 10), (2,), 16, 40, _ARM),
        ("forward_extension", "手腕往前壓", "contact", 35.0, _ARM, (8, 10), (3,), 32, 56, _ARM),
        ("completion", "手腕放鬆回到預備姿勢", "follow_through", 30.0,
         _ARM, _ARM, (4,), 44, 64, _UPPER),
    ),
    "clear": (
        ("preparation", "球拍舉至腰部預備", "preparation", 10.0, _UPPER, _ARM, (0,), 0, 16, None),
        ("body_rotation", "轉身", "rotation", 10.0, _TORSO_LEGS, (11, 12), (1,), 8, 32, _TORSO_LEGS),
        ("arm_balance", "雙手手肘平衡", "rotation", 20.0, _UPPER, (7, 8), (1,), 16, 40, _UPPER),
        ("elbow_forward", "手肘往前轉至前方", "contact", 20.0,
         (0, 6, 8, 10), (6, 8), (2,), 27, 38, _ARM),
        ("wrist_flick", "手腕發力", "contact", 20.0, _ARM, (8, 10), (2,), 24, 48, _ARM),
        ("follow_through", "慣用手肩膀往前轉", "follow_through", 20.0,
         _TORSO_ARM, (6,), (3, 4), 40, 64, None),
    ),
    "smash": (
        ("preparation", "球拍舉至腰部預備", "preparation", 10.0, _UPPER, _ARM, (0,), 0, 16, None),
        ("body_rotation", "轉身", "rotation", 10.0, _TORSO_LEGS, (11, 12), (1,), 8, 32, _TORSO_LEGS),
        ("arm_balance", "雙手手肘平衡", "rotation", 20.0, _UPPER, (7, 8), (1,), 16, 40, _UPPER),
        ("elbow_forward", "手肘往前轉至前方", "contact", 20.0,
         (0, 6, 8, 10), (6, 8), (2,), 27, 38, _ARM),
        ("wrist_flick", "手腕發力", "contact", 20.0, _ARM, (8, 10), (2,), 24, 48, _ARM),
        ("follow_through", "慣用手肩膀往前轉", "follow_through", 20.0,
         _TORSO_ARM, (6,), (3, 4), 40, 64, _TORSO_ARM),
    ),
}

# text shown for a frame that sits on one of the five anchors
CHECKPOINT_ROLES = {
    "serve": ("第0關鍵幀：發球準備起點", "第1關鍵幀：雙手平舉與持拍腳承重", "第2關鍵幀：重心轉移過渡",
              "第3關鍵幀：擊球與手腕發力", "第4關鍵幀：髖部及肩膀完成前旋"),
    "lift": ("第0關鍵幀：腰部放鬆準備", "第1關鍵幀：向後引拍過渡", "第2關鍵幀：向後引拍最低點",
             "第3關鍵幀：手腕往前壓", "第4關鍵幀：手腕放鬆回到預備姿勢"),
    "clear": ("第0關鍵幀：準備動作與轉身起點", "第1關鍵幀：轉身終點與雙手平衡", "第2關鍵幀：手肘前轉與手腕發力",
              "第3關鍵幀：隨揮候選畫面", "第4關鍵幀：隨揮候選畫面與動作終點"),
    "smash": ("第0關鍵幀：引拍準備與轉身起點", "第1關鍵幀：蓄力轉身與雙手平衡", "第2關鍵幀：手肘前轉與前臂加速",
              "第3關鍵幀：軀幹前傾與隨揮", "第4關鍵幀：殺球動作終點"),
}
BETWEEN_ANCHORS = "關鍵幀之間的動作過渡畫面"

HAND_NOTE_UNKNOWN = "關節編號採慣用側正規化；請依提供的handedness判斷實際身體側。"
HAND_NOTE = {
    "left": "關節編號採慣用側正規化。此學生為左手持拍，因此慣用側關節對應身體左側。",
    "right": "關節編號採慣用側正規化。此學生為右手持拍，因此慣用側關節對應身體右側。",
}

# joint index of the source topology that fills each of the 17 joints
H36M_SOURCE = (9, 10, 10, 10, 10, 11, 14, 12, 15, 13, 16, 4, 1, 5, 2, 6, 3)
MEDIAPIPE_SOURCE = (0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)

# camera model of the 2-D/3-D lifting
ROOT_DEPTH = 5.14388

# peak search of the motion window
SMOOTHING = 5
PEAK_OFFSET = 2
SEARCH_BEFORE = 30
SEARCH_AFTER = 30

# end of fixed values
# ---------------------------------------------------------------------------------


def by_skill(values: dict[str, object], skill: Column | str = "skill", kind: str | None = None) -> Column:
    """Per-skill constant as a CASE expression: no join, folds away under a skill filter."""
    column = F.col(skill) if isinstance(skill, str) else skill
    result = None
    for name in SKILLS:
        value = values[name]
        item = F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)
        result = (
            F.when(column == name, item) if result is None else result.when(column == name, item)
        )
    return result.cast(kind) if kind else result


def joint_weight_array(skill: Column | str = "skill") -> Column:
    return by_skill(JOINT_WEIGHTS, skill)


def joint_weights(spark: SparkSession) -> DataFrame:
    rows = [(s, j, w) for s in SKILLS for j, w in enumerate(JOINT_WEIGHTS[s])]
    return inline_table(spark, rows, "skill string, joint int, weight double")


def criteria(spark: SparkSession) -> DataFrame:
    """One row per (skill, criterion): where it looks and what it is worth."""
    rows = []
    for skill in SKILLS:
        for k, rule in enumerate(RULES[skill]):
            rule_id, name, _, maximum, _, _, _, start, end, joints = rule
            metric = (
                "full_transition" if rule_id == "weight_transfer"
                else "joint_mean" if joints else "weighted"
            )
            rows.append((skill, k, rule_id, name, maximum, start, end, joints, metric))
    return inline_table(
        spark,
        rows,
        "skill string, k int, rule_id string, name string, maximum double, "
        "start int, end int, joints array<int>, metric string",
    )


def rules(spark: SparkSession) -> DataFrame:
    rows = [
        (skill, k, r[0], r[1], r[2], r[3], r[4], r[5], r[6])
        for skill in SKILLS
        for k, r in enumerate(RULES[skill])
    ]
    return inline_table(
        spark,
        rows,
        "skill string, k int, rule_id string, name string, phase string, maximum double, "
        "measured_joints array<int>, coaching_joints array<int>, anchor_positions array<int>",
    )


def phase_windows(spark: SparkSession) -> DataFrame:
    rows = [
        (skill, k, name, start, end)
        for skill in SKILLS
        for k, (name, start, end) in enumerate(PHASE_WINDOWS[skill])
    ]
    return inline_table(spark, rows, "skill string, ord int, phase string, start int, end int")


def joint_names(spark: SparkSession) -> DataFrame:
    return inline_table(spark, list(JOINT_NAMES.items()), "joint int, keypoint string")


def contract_violations(spark: SparkSession) -> DataFrame:
    """Constraint checks over the dimension tables; an intact contract gives no rows."""
    weights = (
        joint_weights(spark).groupBy("skill").agg(F.count("*").alias("n"))
        .where("n <> 17").select("skill", F.lit("needs 17 joint weights").alias("violation"))
    )
    totals = (
        criteria(spark).groupBy("skill").agg(F.sum("maximum").alias("total"))
        .where("abs(total - 100) > 1e-8")
        .select("skill", F.lit("criterion maxima must total 100").alias("violation"))
    )
    names = (
        criteria(spark).alias("c")
        .join(rules(spark).alias("r"), ["skill", "k"], "full")
        .where("NOT (c.name <=> r.name) OR NOT (c.maximum <=> r.maximum)")
        .select("skill", F.lit("rules and criteria are misaligned").alias("violation"))
    )
    rule_totals = (
        rules(spark).groupBy("skill").agg(F.sum("maximum").alias("total"))
        .where("abs(total - 100) > 1e-8")
        .select("skill", F.lit("rule maxima must total 100").alias("violation"))
    )
    contract = transitions(spark)
    roles = contract.where("roles <> 5").select("skill", F.lit("needs five checkpoint roles").alias("violation"))
    moving = contract.where("weight > 0 AND (size(joints) = 0 OR size(lean_joints) <> 4)").select(
        "skill", F.lit("transition scoring needs support joints and four torso joints").alias("violation")
    )
    return weights.unionByName(totals).unionByName(rule_totals).unionByName(names).unionByName(roles).unionByName(moving)


def transitions(spark: SparkSession) -> DataFrame:
    """Per skill the full-body transition term and the number of checkpoint roles."""
    rows = []
    for skill in SKILLS:
        used = TRANSITION_WEIGHT[skill] > 0
        joints, lean = (TRANSITION_JOINTS, LEAN_JOINTS) if used else ((), ())
        rows.append((skill, float(TRANSITION_WEIGHT[skill]), joints, lean, len(CHECKPOINT_ROLES[skill])))
    return inline_table(spark, rows, "skill string, weight double, joints array<int>, lean_joints array<int>, roles int")


def checkpoint_violations(spark: SparkSession, checkpoints: DataFrame) -> DataFrame:
    """(checkpoint, violation) of stored models that do not fit the skill they are asked for.

    ``checkpoints`` has checkpoint, requested_skill, skill, joint_weights, transition_weight,
    transition_joints and transition_lean_joints; nulls mean that the model does not say. A
    model without a skill is one of clear, and only those may lack joint weights. The first
    thing that does not fit is named.
    """
    weights = joint_weights(spark).groupBy("skill").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("joint", "weight"))), lambda e: e["weight"]).alias("_w")
    )
    contract = weights.join(transitions(spark), "skill").withColumnsRenamed(
        {"skill": "requested_skill", "weight": "_weight", "joints": "_joints", "lean_joints": "_lean"}
    )
    rows = checkpoints.join(F.broadcast(contract), "requested_skill", "left")
    near = F.forall(
        F.arrays_zip(F.col("joint_weights").alias("a"), F.col("_w").alias("b")),
        lambda e: F.abs(e["a"] - e["b"]) <= 1e-8 + 1e-5 * F.abs(e["b"]),
    )
    fits = F.coalesce((F.size("joint_weights") == JOINTS) & near, F.lit(False))
    none = F.array().cast("array<int>")
    moving = (
        (F.coalesce("transition_weight", F.lit(0.0)) == F.col("_weight"))
        & (F.coalesce(F.col("transition_joints").cast("array<int>"), none) == F.col("_joints"))
        & (F.coalesce(F.col("transition_lean_joints").cast("array<int>"), none) == F.col("_lean"))
    )
    clear = F.col("requested_skill") == "clear"
    unsaid = F.col("joint_weights").isNull()
    violation = (
        F.when(F.col("_w").isNull(), "the requested skill is not supported")
        .when(F.coalesce("skill", F.lit("clear")) != F.col("requested_skill"), "the model is of another skill")
        .when(unsaid & clear, F.lit(None))
        .when(unsaid, "the model does not contain joint weights")
        .when(~fits, "joint weights do not match the contract")
        .when(~F.coalesce(moving, F.lit(False)), "transition scoring does not match the contract")
    )
    return rows.select("checkpoint", violation.alias("violation")).where("violation IS NOT NULL")
