"""Top-k search, hard negatives and whitening against plain Python, also on odd rows."""

import random
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest

from motionlake.llm import blockmax, grid, negatives, whitening
from motionlake.llm.common import read

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, key int, x string, q long, block int, place int, n int, i int"


def finite(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def integer(v):
    return [min(max(int(np.floor(256 * Fraction(c))), -(2**63)), 2**63 - 1) for c in v]


def product(a, b):
    return min(max(sum(p * q for p, q in zip(a, b)), -grid.MOST), grid.MOST)


def table(spark, vectors):
    return spark.createDataFrame([(*v, 1, "x", 2, 3, 4, 5, 6) for v in vectors], SCHEMA).repartition(3)


def clustered(seed=3, n=400, dim=6):
    """Few directions, coarse components: many ties, equal vectors and repeated rows."""
    rng = random.Random(seed)
    centres = [[rng.randint(-3, 3) / 4 for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.choice([0, 0, 0, 1 / 256, -1 / 256]) for x in c], rng.choice([0, 0, 1, 2])))
    return rows + rows[:40]


ODD = [
    (0, [1.0, 0.5], 0), (50, [0.5, -0.5, 2.0], 0), (100, [], 0), (100, [], 0), (150, None, 0), (200, [NAN, 1.0], 0),
    (250, [None, 1.0], 0), (300, [INF], 0), (None, [1.0, 1.0], 0), (None, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 0),
    (3, [1e30, -1e30], 0), (4, [1e12, 1e12], 1), (350, [1e12, -1e12], 1), (350, [1.0, 1.0], 1), (-50, [0.0, 0.0], 0), (7, [0.25, 0.0], None),
    (14, [0.25, 0.25], 9), (21, [0.75, 0.25], -1), (400, [0.75, 0.75], 0), (5, [0.5, 0.5], 1),
]


def brute_nearest(vectors, k=5):
    rows = {(brute.key(i), tuple(integer(v))) for i, v, _ in vectors if finite(v)}
    out = []
    for i, x in rows:
        if i % 50 == 0 and i != brute.LAST:
            others = sorted((-product(x, y), j) for j, y in rows if j != i)
            out += [(i, r, None if j == brute.LAST else j, -s) for r, (s, j) in enumerate(others[:k], 1)]
    return sorted(out, key=repr)


def brute_negatives(vectors):
    rows = set()
    for i, v, label in vectors:
        if finite(v) and label is not None:
            if i is not None and i % 7 == 0:
                label = int(np.fmod(label + 1, 10))
            rows.add((brute.key(i), label, tuple(integer(v))))
    out = []
    for i, label, x in rows:
        if i % 50 or i == brute.LAST:
            continue
        same = sorted((-product(x, y), j) for j, m, y in rows if j != i and m == label)[:5]
        other = sorted((-product(x, y), j) for j, m, y in rows if j != i and m != label)
        for p, pos in same:
            inside = [(s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p][:3]
            names = [None if j == brute.LAST else j for j in (pos, *(j for _, j in inside))]
            out += [(i, names[0], r, names[r], -p, -s) for r, (s, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("vectors", [clustered(), ODD, [], ODD[:2], [v for v in ODD if v[0] == 150]], ids=["ties", "odd", "none", "two", "null"])
def test_nearest(spark, vectors):
    assert rows(blockmax.nearest(table(spark, vectors))) == brute_nearest(vectors)


@pytest.mark.parametrize("vectors", [clustered(), ODD, [], ODD[:2], [v for v in ODD if v[0] == 150]], ids=["ties", "odd", "none", "two", "null"])
def test_hard_negatives(spark, vectors):
    assert rows(negatives.mine(table(spark, vectors))) == brute_negatives(vectors)


def test_search_over_many_cells(spark, monkeypatch):
    """Chunks and shards far smaller than the table give the same rows."""
    monkeypatch.setattr(grid, "CHUNK_QUERIES", 3)
    monkeypatch.setattr(grid, "SHARD_COMPONENTS", 512)
    vectors = clustered(5, 900, 6)
    assert rows(blockmax.nearest(table(spark, vectors))) == brute_nearest(vectors)
    assert rows(negatives.mine(table(spark, vectors))) == brute_negatives(vectors)


def test_blocks_below_the_floor_are_not_scored(monkeypatch):
    """Two far clusters: a query near the first leaves the blocks of the second alone."""
    scored = []
    plain = grid.products

    def counted(a, b):
        if a.ndim == 3:
            scored.append(len(a))
        return plain(a, b)

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(100, 120, (512, 8)), rng.integers(-120, -100, (512, 8))])
    data = [x[s : s + blockmax.BLOCK] for s in range(0, 1024, blockmax.BLOCK)]
    blocks = pa.table({
        "keys": pa.array([list(range(s, s + blockmax.BLOCK)) for s in range(0, 1024, blockmax.BLOCK)]),
        "x": pa.array([b.ravel().tolist() for b in data]), "width": pa.array([8] * len(data), pa.int32()),
        "high": pa.array([b.max(axis=0).tolist() for b in data]), "low": pa.array([b.min(axis=0).tolist() for b in data]),
    })
    queries = pa.table({"q": [1], "key": [5000], "x": [[10] * 8], "floor": [blockmax.NOTHING]})
    monkeypatch.setattr(grid, "products", counted)
    got = blockmax.visit(queries, blocks, 5)
    score = x.sum(axis=1) * 10
    want = np.lexsort((np.arange(1024), -score))[:5]
    assert sorted(got.column("key").to_pylist()) == sorted(want.tolist()) and sum(scored) <= 8


@pytest.mark.parametrize("bits", [1, 8, 20, 40, 70])
def test_packed_products_are_exact(bits):
    rng = random.Random(bits)
    dim, m, most = 9, 33, 2 ** min(bits, 62)
    x = np.array([[rng.randint(-most, most - 1) for _ in range(dim)] for _ in range(m)])
    anchor = [rng.randint(-most, most - 1) for _ in range(dim)]
    spread = 2 * most
    field = -(-(dim * spread**2).bit_length() // 8)
    source = pa.RecordBatch.from_arrays([pa.array([1] * m), pa.array(range(m)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["label", "key", "x"])
    (batch,) = negatives._packs(iter([source]), most, dim, field)
    pack = negatives.Pack(batch.column("keys")[0], batch.column("sums")[0], batch.column("wide")[0], most, field)
    assert pack.scores([a + most for a in anchor], sum(anchor)).tolist() == [product(anchor, y) for y in x.tolist()]


def check_whitening(spark, vectors, result):
    good = [(i, integer(v)) for i, v, _ in vectors if finite(v)]
    dim = max((len(x) for _, x in good), default=0)
    good = [(i, tuple(x + [0] * (dim - len(x)))) for i, x in good]
    fit = sorted({x for _, x in good})
    n, k = len(fit), min(4, dim)
    sums = [sum(c) for c in zip(*fit)]
    got = [tuple(r) for r in result.collect()]
    want = [(i, c, n, d if d < 2**63 else None) for i, x in good for c in range(1, k + 1) for d in [sum((n * a - s) ** 2 for a, s in zip(x, sums))]]
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    if not got:
        return
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    for c in range(k):
        mine = [(r[0], r[4], r[5], r[6]) for r in got if r[1] == c + 1]
        if values.sum() > 0:
            assert all(abs(r[2] - values[c] / values.sum()) <= 1e-4 * values[c] / values.sum() + 1e-15 for r in mine)
        if values[c] <= 1e-12 * values[0]:
            assert all(r[1] is None for r in mine)
            continue
        assert all(r[3] <= 1e-4 for r in mine)
        exact = [(i, float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ turned[:, c] / np.sqrt(values[c]))) for i, x in good]
        pairs = list(zip(sorted(mine, key=lambda r: (repr(r[0]), abs(r[1]))), sorted(exact, key=lambda r: (repr(r[0]), abs(r[1])))))
        assert max(abs(abs(a[1]) - abs(b[1])) for a, b in pairs) < 1e-6


def test_whitening(spark, sf_dir):
    source = read(spark, sf_dir, "embeddings")
    check_whitening(spark, [tuple(r) for r in source.select("vec_id", "embedding", "label").collect()], whitening.whiten(source))


def test_whitening_of_badly_conditioned_vectors(spark):
    """Variances over nine orders of magnitude, and a dimension that is a sum of others."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 4)) * [1e5, 3e3, 40.0, 5.0]
    vectors = [(i, [*v, float(np.floor(256 * v[0]) / 256 + np.floor(256 * v[1]) / 256), 7.0], 0) for i, v in enumerate(base.tolist())]
    check_whitening(spark, vectors, whitening.whiten(table(spark, vectors)))


def test_whitening_of_odd_rows(spark):
    small = [v for v in ODD if v[0] not in (3, 4, 350)]
    for vectors in (small, [], [(1, [0.5, 0.5], 0)] * 3, [(1, [], 0)], [(1, [1.0], 0), (2, [2.0], 0)], clustered()):
        if all(not v[1] for v in vectors):
            assert whitening.whiten(table(spark, vectors)).count() == 0
        else:
            check_whitening(spark, vectors, whitening.whiten(table(spark, vectors)))
    huge = whitening.whiten(table(spark, ODD)).collect()
    assert {r.deviation for r in huge} == {None} and all(r.identity_error <= 1e-4 for r in huge)
