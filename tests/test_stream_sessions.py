"""Session incidents of a stream against the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import correlate
from vigilog.streaming import sessions
from helpers import at

SECOND = 1_000_000
GAP = 30 * SECOND
DDL = "signal_id string, signal_type string, severity string, service string, detected_at timestamp"


@pytest.fixture
def make(spark):
    def signals(rows):
        return spark.createDataFrame(
            [(i, kind, severity, service, None if t is None else at(t)) for i, t, service, kind, severity in rows], DDL)

    return signals


def some(rng, n, span):
    return [(f"s{i:04d}", rng.randrange(span), rng.choice(["a", "a", "a", "b", None]), rng.choice(["X", "Y"]),
             rng.choice(["LOW", "MEDIUM", "HIGH", "critical", None, "odd"])) for i in range(n)]


def values(df):
    return sorted(map(str, df.collect()))


def standing(spark, root):
    """The rows that the log of changes leaves standing."""
    log = sessions.session_changes(spark, root).withColumn("context_data", F.to_json("context_data"))
    left = log.groupBy(*[c for c in log.columns if c not in ("op", "batch")]).agg(F.sum("op").alias("op"))
    assert left.filter("op not in (0, 1)").count() == 0
    return left.filter("op = 1").drop("op")


def same_as_batch(spark, make, root, rows):
    want = correlate.incident_sessions(make(rows), GAP)
    assert values(sessions.sessions(spark, root)) == values(want)
    as_text = want.withColumn("context_data", F.to_json("context_data"))
    assert values(standing(spark, root).select(*as_text.columns)) == values(as_text)
    assert values(sessions.session_links(spark, root, GAP)) == values(correlate.session_links(make(rows), GAP))


def test_any_order_gives_the_sessions_of_the_batch(spark, make, tmp_path):
    rng, root = random.Random(1), str(tmp_path)
    rows = some(rng, 120, 3000)
    rows += rows[::7]  # repeated rows
    rng.shuffle(rows)
    for number in range(3):
        part = rows[number * 46:(number + 1) * 46]
        # Each batch is run twice, as after a failure.
        for _ in range(2 if number == 1 else 1):
            sessions.merge_batch(make(part), number, root, GAP, 10_000 * SECOND)
    same_as_batch(spark, make, root, rows)
    back = sessions.session_changes(spark, root).filter("op = -1")
    assert back.count() > 10


def test_a_late_row_joins_two_sessions_and_takes_both_back(spark, make, tmp_path):
    root = str(tmp_path)
    rows = [("a", 0, "svc", "X", "LOW"), ("b", 60, "svc", "X", "HIGH")]
    sessions.merge_batch(make(rows), 0, root, GAP, 100 * SECOND)
    before = {r.incident_id for r in sessions.sessions(spark, root).collect()}
    assert len(before) == 2
    sessions.merge_batch(make([("c", 30, "svc", "X", "LOW")]), 1, root, GAP, 100 * SECOND)
    (one,) = sessions.sessions(spark, root).collect()
    assert (one.occurrence_count, one.priority, one.context_data) == (3, "HIGH", {"first_signal": "a", "last_signal": "b"})
    log = sessions.session_changes(spark, root).filter("batch = 1").collect()
    assert sorted(r.op for r in log) == [-1, -1, 1] and {r.incident_id for r in log if r.op == -1} == before
    assert {r.incident_id for r in sessions.session_links(spark, root, GAP).collect()} == {one.incident_id}
    # A batch without rows for it says nothing of it.
    sessions.merge_batch(make([("d", 31, "other", "X", "LOW")]), 2, root, GAP, 100 * SECOND)
    assert {r.service for r in sessions.session_changes(spark, root).filter("batch = 2").collect()} == {"other"}
    same_as_batch(spark, make, root, [*rows, ("c", 30, "svc", "X", "LOW"), ("d", 31, "other", "X", "LOW")])


def test_ended_sessions_leave_the_state_and_rows_behind_the_horizon_are_kept_apart(spark, make, tmp_path):
    root = str(tmp_path)
    first = [("a", 0, "svc", "X", "LOW"), ("b", 30, "svc", "X", "LOW"), ("edge", 100, "svc", "X", "LOW")]
    sessions.merge_batch(make(first), 0, root, GAP, 10 * SECOND)  # horizon 90
    assert spark.read.parquet(f"{root}/open/slot=0").count() == 1
    # 91 is in time and within the gap of the session of 100; 90 is late.
    second = [("c", 91, "svc", "X", "LOW"), ("late", 90, "svc", "X", "LOW")]
    sessions.merge_batch(make(second), 1, root, GAP, 10 * SECOND)
    assert [r.signal_id for r in spark.read.parquet(f"{root}/late").collect()] == ["late"]
    same_as_batch(spark, make, root, first + second[:1])


def test_rows_in_order_within_the_lateness_equal_the_batch(spark, make, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "out")
    rows = sorted(some(rng, 200, 4000), key=lambda r: r[1] + rng.random() * 50)
    for i in range(3):
        make(rows[i * 67:(i + 1) * 67]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.follow(stream, root, GAP, 60 * SECOND).awaitTermination()
    same_as_batch(spark, make, root, rows)
    assert spark.read.parquet(f"{root}/closed").count() > 20


def test_no_rows_and_rows_without_a_time(spark, make, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no micro-batch"):
        sessions.sessions(spark, root)
    sessions.merge_batch(make([]), 0, root, GAP, SECOND)
    assert sessions.sessions(spark, root).count() == sessions.session_links(spark, root, GAP).count() == 0
    rows = [("n1", None, "svc", "X", "LOW"), ("a", 5, "svc", "X", None), ("n2", None, "svc", "X", "HIGH")]
    for number, row in enumerate(rows, 1):
        sessions.merge_batch(make([row]), number, root, GAP, SECOND)
    same_as_batch(spark, make, root, rows)


def test_a_session_without_end_is_one_row(spark, make, tmp_path):
    root = str(tmp_path)
    rows = [(f"s{i:05d}", i * 5, "svc", "X", "LOW") for i in range(2000)]
    for number in range(2):
        sessions.merge_batch(make(rows[number * 1000:(number + 1) * 1000]), number, root, GAP, 10 * SECOND)
    assert spark.read.parquet(f"{root}/open/slot=1").count() == 1
    same_as_batch(spark, make, root, rows)
