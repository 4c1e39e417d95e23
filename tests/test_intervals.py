"""Interval correlation, band joins and as-of joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from vigilog.operators import asof, correlate, ordered, respond, windows

SIGNAL = "signal_id string, signal_type string, severity string, service string, trace_id string, detected_at timestamp"


def signals(spark, rows):
    return spark.createDataFrame(
        [(f"s{i:04d}", kind, "HIGH", service, trace, None if t is None else at(t))
         for i, (t, kind, service, trace) in enumerate(rows)], SIGNAL).repartition(4)


def brute_links(rows, within, by):
    """(id, links, start of its group) by looking at all pairs."""
    timed = [(i, t, trace if by else None) for i, (t, _, _, trace) in enumerate(rows) if t is not None]
    out = {}
    for i, t, trace in timed:
        near = [u for j, u, other in timed if j != i and other == trace and abs(u - t) <= within]
        start = t
        for _, u, _ in sorted((x for x in timed if x[2] == trace and x[1] < t), key=lambda x: -x[1]):
            if start - u > within:
                break
            start = u
        out[f"s{i:04d}"] = (len(near), start)
    return out


@pytest.mark.parametrize("by", [[], ["trace_id"]])
def test_interval_links_equal_all_pairs(spark, by):
    rng = random.Random(len(by))
    rows = [(rng.choice([None, *[x / 4 for x in range(4000)]]), rng.choice("AB"), rng.choice("xyz"), rng.choice(["t1", "t1", "t2", None]))
            for _ in range(300)] + [(500.0, "A", "x", "t1")] * 20
    got = correlate.interval_links(signals(spark, rows), 2_500_000, by).collect()
    base = int(at(0).timestamp() * 1e6)
    assert {r.signal_id: (r.n_links, (r.group_start_us - base) / 1e6) for r in got} == brute_links(rows, 2.5, by)


def test_two_signals_over_the_hour_are_one_group(spark):
    """An hour of the clock ends 50 minutes after the tests' start."""
    rows = [(2999.0, "A", "x", "t"), (3001.0, "B", "y", "t")]
    group, = correlate.interval_groups(signals(spark, rows), 5_000_000).collect()
    assert (group.n_signals, group.n_links, group.services, group.cross_service) == (2, 1, ["x", "y"], True)
    assert correlate.correlated_groups(signals(spark, rows), 3_600_000_000).count() == 2


def test_a_hot_trace_is_spread(spark):
    """One trace with all signals: its running sums are in several ranges."""
    rows = [(i / 10, "A", "x", "t") for i in range(2000)]
    links = correlate.interval_links(signals(spark, rows), 1_000_000, ["trace_id"])
    assert links.agg(F.sum("n_links")).first()[0] == 2 * sum(2000 - k for k in range(1, 11))
    assert links.select("group_id").distinct().count() == 1
    df = spark.range(2000).select(F.lit("t").alias("k"), F.col("id").alias("us"), F.lit(1).alias("v")).repartition(4)
    rows, reports = ordered._walked(df, ["k"], ["us"], [], lambda walked: ((b, [], n) for b, _, _, n in walked))
    assert rows.groupBy(F.spark_partition_id()).count().count() > 1


def test_no_signals_no_groups(spark):
    none = signals(spark, []).limit(0)
    assert correlate.interval_groups(none, 1000).collect() == []
    assert correlate.interval_links(none, 1000).collect() == []


@pytest.mark.parametrize("split", [3, 1000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_band_join_equals_all_pairs(spark, keys, split):
    rng = random.Random(split)

    def rows(n):
        return [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-40, 60)])) for i in range(n)]

    left, right = rows(60), rows(80) + [(200 + i, "a", 7) for i in range(30)]
    ddl = "id int, k string, t int"
    got = correlate.band_join(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), keys, "t", "t", 3, 8, split)
    want = sorted((a, b) for a, ka, ta in left for b, kb, tb in right
                  if ta is not None and tb is not None and ta - 3 <= tb <= ta + 8 and (not keys or (ka is not None and ka == kb)))
    assert sorted((r.l.id, r.r.id) for r in got.collect()) == want and want


def rows_sent(plan):
    """Rows that the exchanges of a plan that has run have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_sent(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(rows_sent(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("seconds", [[i // 4 for i in range(400)], [7] * 400], ids=["dense", "one moment"])
def test_a_denser_band_join_sends_rows_no_more_often(spark, seconds):
    def sent(copies):
        rows = [(n, t) for n, t in enumerate(t for t in seconds for _ in range(copies))]
        frame = spark.createDataFrame(rows, "id int, t bigint").repartition(4)
        pairs = correlate.band_join(frame, frame, [], "t", "t", 0, 9, split=5)
        plan = pairs._jdf.queryExecution().executedPlan()
        n_pairs = sum(1 for a in seconds for b in seconds if a <= b <= a + 9) * copies**2
        assert len(plan.executeCollect()) == n_pairs
        assert pairs.groupBy(F.spark_partition_id()).count().count() > 2
        return rows_sent(plan) / len(rows)

    # As for tables too large to be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once, thrice = sent(1), sent(3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert once >= 2 and thrice < 1.2 * once


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_a_loop(spark, strict):
    rng = random.Random(7)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), "L") for i in range(300)]
    right = sorted({(rng.choice(["a", "b", None, "c"]), rng.choice([None, *range(50)])) for _ in range(60)}, key=str)
    right = [(k, t, j if j % 5 else None, "R") for j, (k, t) in enumerate(right)]
    got = asof.asof_join(
        spark.createDataFrame(left, "id int, k string, t int, side string").repartition(3),
        spark.createDataFrame(right, "k string, u int, v int, side string"), ["k"], "t", "u", ["v", "u"], strict)
    want = []
    for i, k, t, side in left:
        past = [(u, v) for k2, u, v, _ in right if k2 == k and None not in (u, t) and (u < t or (u == t and not strict))]
        u, v = max(past, key=lambda x: x[0], default=(None, None))
        want.append((i, k, t, side, v, u))
    assert got.columns == ["id", "k", "t", "side", "v", "u"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_previous_sum_and_last_over_many_ranges(spark):
    """Long and short keys, nulls, copies; more ranges than keys and the reverse."""
    rng = random.Random(9)
    for n_keys in (1, 2, 40, 4000):
        rows = [(f"k{rng.randrange(n_keys)}" if rng.random() > .05 else None, i, rng.choice([None, rng.randrange(9)])) for i in range(1500)]
        df = spark.createDataFrame(rows, "k string, us long, v long").repartition(5)
        prev = {r.us: r.before for r in ordered.with_previous(df, ["k"], ["us"], {"us": "before"}).collect()}
        sums = {r.us: r.total for r in ordered.with_running_sum(df, ["k"], ["us"], "v", "total").collect()}
        last = {r.us: r.latest for r in ordered.with_last(df, ["k"], ["us"], "v", "latest").collect()}
        state = {}
        for k, us, v in rows:
            before, total, latest = state.get(k, (None, 0, None))
            assert prev[us] == before
            total, latest = total + (v or 0), latest if v is None else v
            assert (sums[us], last[us]) == (total, latest)
            state[k] = (us, total, latest)


def test_later_outcomes_change_nothing(spark):
    books = spark.createDataFrame(
        [("p1", "E", "LOW", "CRITICAL", 1, "a"), ("p2", "E", "LOW", "CRITICAL", 1, "b"), ("p3", "E", "LOW", "LOW", 9, "c")],
        "playbook_id string, trigger_signal string, min_severity string, max_severity string, priority int, action string")
    opened = spark.createDataFrame(
        [("i1", "E", "HIGH", at(0)), ("i2", "E", "HIGH", at(20)), ("i3", "E", "high", at(40)), ("i4", "F", "HIGH", at(0)),
         ("i5", "E", "LOW", at(99))], "id string, error string, severity string, created_at timestamp")
    done = [("E", "b", "success", at(10)), ("E", "a", "failed", at(12)), ("E", "b", "failed", at(30)), ("E", "a", "success", at(31)),
            ("E", "a", "success", at(32)), ("E", "a", "success", None)]
    ddl = "error string, action string, status string, executed_at timestamp"

    def chosen(history):
        rows = respond.choose_playbooks_as_of(opened, books, spark.createDataFrame(history, ddl)).collect()
        return {r.incident_id: (r.playbook_id, r.success_rate, r.tried) for r in rows}

    want = {"i1": ("p1", 0.0, 0), "i2": ("p2", 1.0, 1), "i3": ("p1", 0.666667, 3), "i4": (None, None, None), "i5": ("p3", 0.0, 0)}
    assert chosen(done) == want
    assert chosen([*done, *[("E", "b", "success", at(50))] * 9]) == want


def test_window_count_on_both_sides(spark):
    rows = [("a", t) for t in (0, 5, 5, 9, 30)] + [(None, 4), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, us long")
    got = windows.window_count(df, ["k"], "us", 5, 4, "n").collect()
    want = [(k, t, sum(1 for k2, u in rows if k2 == k and t - 5 <= u <= t + 4)) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
