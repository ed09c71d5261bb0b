"""Average ranks, rank correlation and grading summary against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions import ordered
from motionlake.operators import evaluate as E


def _ranks(values):
    """1-based average ranks; NaN is last, null has none."""
    values = [math.inf if v is not None and math.isnan(v) else v for v in values]
    known = [v for v in values if v is not None]
    return [None if v is None else sum(k < v for k in known) + (sum(k == v for k in known) + 1) / 2 for v in values]


def _values(seed, n):
    rng = np.random.default_rng(seed)
    values = [float(v) for v in rng.integers(-6, 7, n) / 3]
    # one value over and over, others that share a value block, nothing, both zeros
    for i in range(0, n, 4):
        values[i] = 1.25
    for i in range(1, n, 9):
        values[i] = 1.25 + i * 1e-9
    values[2], values[3], values[5], values[7], values[11] = None, None, 0.0, -0.0, 1e300
    return values


@pytest.mark.parametrize("block_rows", [3, 1 << 20])
def test_average_ranks_of_rows_whatever_the_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block_rows)
    rows = [(g, i, v) for g in (0, 1) for i, v in enumerate(_values(g, 90))]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    got = {(r.g, r.i): r.r for r in ordered.with_average_ranks(df, ["g"], "v", "r").collect()}
    assert len(got) == len(rows)
    for g in (0, 1):
        assert [got[g, i] for i in range(90)] == _ranks([v for h, _, v in rows if h == g])


@pytest.mark.parametrize("block_rows", [3, 1 << 20])
def test_grading_summary_equals_plain_ranks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block_rows)
    a, b = _values(3, 80), _values(4, 80)
    label = ["experts" if i % 3 else "beginners" for i in range(80)]
    split = ["calibration" if i % 3 == 0 and i % 5 == 0 else "test" for i in range(80)]
    a[6] = math.nan
    rows = [(1, "lift" if i % 2 else "clear", label[i], split[i], a[i], b[i], 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "candidate int, skill string, label string, split string, total_score double, oracle_total_score double, criterion_score_mae double")
    got = {r.skill: r for r in E.grading_summary(df).collect()}
    assert set(got) == {"lift", "clear", "all"}
    for skill, row in got.items():
        test = [r for r in rows if r[3] == "test" and skill in (r[1], "all")]
        ra, rb = _ranks([r[4] for r in test]), _ranks([r[5] for r in test])
        x, y = zip(*[(p, q) for p, q in zip(ra, rb) if p is not None and q is not None])
        assert row.score_spearman == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        lowered = _ranks([None if r[4] is None else -r[4] for r in test])
        pos = [k for k, r in zip(lowered, test) if k is not None and r[2] == "beginners"]
        neg = [k for k, r in zip(lowered, test) if k is not None and r[2] == "experts"]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert row.expert_beginner_auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
        assert row.test_samples == len(test) and row.test_beginners == sum(r[2] == "beginners" for r in test)
    cal = [r[4] for r in rows if r[3] == "calibration" and r[4] is not None]
    assert got["all"].calibration_beginner_score_mean == pytest.approx(np.mean(cal))


def test_rank_correlation_moves_its_rows_twice(spark):
    """One move a value; the earlier plan joined every row with both rank tables on its value."""
    df = spark.range(20000).select(F.lit(1).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    out = E.spearman(df, "a", "b", ["g"])
    assert out.collect()[0].spearman == pytest.approx(0, abs=0.05)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert not any("hashpartitioning" in line and " a#" in line.split("hashpartitioning")[1] for line in plan.splitlines())
