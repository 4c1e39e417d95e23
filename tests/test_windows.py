import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from vigilog.operators import ordered, windows


def one_by_one(rows, n, window):
    """Plain loop over sorted (key, us, id) rows."""
    held, fired = {}, []
    for key, us, ident in sorted(rows):
        times = [t for t in held.get(key, []) if us - t <= window] + [us]
        if len(times) >= n:
            fired.append((key, us, ident))
            times = []
        held[key] = times
    return sorted(fired)


def fire(spark, rows, n, window):
    df = spark.createDataFrame(rows, "k string, us long, id string")
    out = windows.emit_and_reset(df, "k", "us", "id", n, window)
    return sorted((r.k, r.us, r.id) for r in out.collect())


@pytest.mark.parametrize("n, gap, expected", [(5, 15_000_000, 1), (5, 15_000_001, 0), (1, 9, 5)])
def test_exact_window_edge(spark, n, gap, expected):
    rows = [("a", i * gap, f"{i}") for i in range(5)]
    assert len(fire(spark, rows, n, 60_000_000)) == expected


def test_reset_after_firing(spark):
    assert len(fire(spark, [("", i, f"{i:03d}") for i in range(19)], 10, 1000)) == 1
    assert len(fire(spark, [("", i, f"{i:03d}") for i in range(20)], 10, 1000)) == 2


def test_keys_do_not_mix(spark):
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(4)]
    assert fire(spark, rows, 5, 1000) == []


def test_copies_count_each(spark):
    """Identical rows are separate occurrences, however many there are."""
    assert len(fire(spark, [("a", 7, "same")] * 5, 5, 0)) == 1
    assert len(fire(spark, [("a", 7, "same")] * 1000 + [("b", 7, "x")], 10, 0)) == 100


def test_rows_without_key_are_left_out(spark):
    assert fire(spark, [(None, i, f"{i}") for i in range(5)] + [("a", 1, "a")], 5, 100) == []


@pytest.mark.parametrize("seed", range(6))
def test_equals_loop_with_hot_key(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(rng.choice([300, 30_000])), f"{i:05d}"))
    n, window = rng.choice([(2, 5), (3, 100), (5, 50), (10, 400), (7, 0)])
    assert fire(spark, rows, n, window) == one_by_one(rows, n, window)


@settings(max_examples=200, deadline=None)
@given(
    gaps=st.lists(st.integers(0, 12), min_size=0, max_size=60),
    n=st.integers(1, 6),
    window=st.integers(0, 25),
    cuts=st.lists(st.integers(0, 60), max_size=6),
    piece=st.integers(1, 9),
)
def test_runs_join_up_at_any_cut(gaps, n, window, cuts, piece):
    """One key cut into tasks anywhere, each fed in pieces, equals the loop."""
    times = np.cumsum(gaps).astype(np.int64) if gaps else np.empty(0, np.int64)
    edges = sorted({0, len(times), *[c for c in cuts if c < len(times)]})
    reports, marked, heads = [], [], []
    for task, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        run = windows._Run("k", n, n, window)
        for at in range(lo, hi, piece):
            part = times[at:min(at + piece, hi)]
            for spot, runs in run.feed(part).items():
                marked.append((task, at + spot, runs))
        heads += [(task, lo + i, i) for i in range(min(n - 1, hi - lo))]
        reports.append(run.report(task))
    expected = [int(r[2]) for r in one_by_one([("k", int(t), f"{i:05d}") for i, t in enumerate(times)], n, window)]
    if not reports:
        assert expected == []
        return
    picks = windows._choose({"k": (n, window)})(pd.DataFrame(reports)).set_index("_task")
    got = [row for task, row, runs in marked if picks.loc[task, "_run"] in runs]
    got += [row for task, row, i in heads if picks.loc[task, "_hit"] == i]
    assert sorted(got) == expected


@pytest.mark.parametrize("seed", range(4))
def test_sliding_count_equals_range_window(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.randrange(400), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, us long, id int")
    width = rng.choice([0, 7, 90])
    out = windows.sliding_count(df, ["k"], "us", width)
    by_range = Window.partitionBy("k").orderBy("us").rangeBetween(-width, 0)
    want = df.withColumn("in_window", F.count("*").over(by_range))
    key = lambda r: (r.k or "", r.us, r.id, r.in_window)
    assert sorted(map(key, out.collect())) == sorted(map(key, want.collect()))


def test_previous_row_crosses_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, us long, v string")
    out = ordered.with_previous(df, ["k"], ["us"], {"v": "before"})
    want = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("us")))
    as_map = lambda d: {r.us: r.before for r in d.collect()}
    assert as_map(out) == as_map(want)


def test_running_sum_crosses_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, us long, v long")
    out = ordered.with_running_sum(df, ["k"], ["us"], "v", "total")
    upto = Window.partitionBy("k").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("total", F.sum("v").over(upto))
    as_map = lambda d: {r.us: r.total for r in d.collect()}
    assert as_map(out) == as_map(want)


def test_hot_key_is_spread(spark):
    """One key's rows do not end up in one range."""
    df = spark.createDataFrame([("hot", i) for i in range(4000)], "k string, us long")
    sizes = ordered.ranged(df, ["k"], ["us"]).groupBy("_range").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000


def test_copies_are_spread(spark):
    df = spark.createDataFrame([("hot", 1)] * 4000, "k string, us long").repartition(4)
    sizes = ordered.ranged(df, ["k"], ["us"]).groupBy("_range").count().collect()
    assert max(r["count"] for r in sizes) < 2000
