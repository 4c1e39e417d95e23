import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.llm import hard_negatives

DDL = "vec_id long, label int, embedding array<double>, rank int, words string"


def frame(spark, rows):
    made = [(i, label, None if v is None else [None if x is None else float(x) for x in v], 1, "w") for i, label, v in rows]
    return spark.createDataFrame(made, DDL)


def brute(rows, positives=5, negatives=10, band=(30, 90)):
    """``rows``: (id, label, whole numbers)."""
    out = []
    for a, label, q in rows:
        if a % 100:
            continue
        scored = sorted((-int(np.dot(q, v)), i, x) for i, x, v in rows if i != a and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, i) for n, i, x in scored if x != label and band[0] * -ps <= 100 * -n <= band[1] * -ps]
            out += [(a, p, k + 1, i, -ps, -n) for k, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **how):
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.whole_vectors(df, 1), F.col("vec_id") % 100 == 0, **how).collect()))


@pytest.mark.parametrize("dim,levels,planes", [(5, 1, 1), (64, 6, 6), (70, 3, 4)])
def test_intervals_hold_the_scores(dim, levels, planes):
    rng = np.random.default_rng(dim)
    x = rng.integers(-200, 200, (400, dim))
    x[0] = 0
    q = rng.integers(-200, 200, (30, dim))
    q[0] = 0
    low, high = hard_negatives.intervals(q, *hard_negatives.encode(x, levels), planes)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()


def test_more_levels_are_tighter():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 64)) * 256, rng.standard_normal((20, 64)) * 256
    widths = []
    for levels in (1, 3, 6):
        low, high = hard_negatives.intervals(q, *hard_negatives.encode(x, levels), 8)
        widths.append(np.median(high - low))
    assert widths[1] < widths[0] / 2 and widths[2] < widths[1] / 2


@pytest.mark.parametrize("dim,spread,block_rows", [(3, 4, 50), (16, 30, 97), (66, 200, 4000)])
def test_mining_equals_brute_force(spark, dim, spread, block_rows):
    rng = np.random.default_rng(dim)
    rows = [(int(i), int(rng.integers(3)), v.tolist()) for i, v in zip(rng.permutation(1200), rng.integers(-spread, spread + 1, (600, dim)))]
    got = mined(frame(spark, rows), block_rows=block_rows)
    assert got == brute(rows) and got


def test_copies_and_a_hot_label(spark):
    """A third of the rows are one vector; ties go to smaller ids."""
    rng = np.random.default_rng(8)
    rows = [(i, 0 if i % 3 else 1, [5, 5, 1]) for i in range(300)]
    rows += [(1000 + i, int(i % 4), v.tolist()) for i, v in enumerate(rng.integers(0, 9, (300, 3)))]
    assert mined(frame(spark, rows), block_rows=64) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [4, 4]), (1, 1, [4, 3]), (2, 2, [2, 2]), (3, 2, None), (4, None, [2, 2]), (None, 2, [2, 2]), (5, 2, [nan, 1]),
            (6, 2, [inf, 2]), (7, 2, [None, 2]), (8, 2, []), (9, 2, [1e12, 1e12]), (10, 2, [2, 2, 2]), (2, 2, [2, 2]),
            (11, 2, [2, 1]), (11, 3, [3, 3]), (100, 7, [1, 1]), (200, 1, [-4, -4]), (300, 1, [0, 0])]
    clean = [(0, 1, [4, 4]), (1, 1, [4, 3]), (2, 2, [2, 2]), (10, 2, [2, 2, 2]), (11, 2, [2, 1]), (100, 7, [1, 1]),
             (200, 1, [-4, -4]), (300, 1, [0, 0])]
    assert mined(frame(spark, rows)) == brute(clean)
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, [(0, 1, [1]), (1, 2, [1])])) == []


def test_components_are_floored(spark):
    row = hard_negatives.whole_vectors(frame(spark, [(1, 0, [-0.001, 0.01, 1.0])])).first()
    assert row.v == [-1, 2, 256]
