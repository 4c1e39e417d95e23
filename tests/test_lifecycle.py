"""Lifecycle with deadlines: batch against a plain walk, stream against batch."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from vigilog import schema
from vigilog.operators import incidents as inc, lifecycle
from vigilog.streaming import lifecycle as streamed, pipeline

OPENED = "id string, status string, created_at timestamp"
UPDATES = "id string, status string, changed_at timestamp, seq bigint"
DEADLINES = {"open": 30, "in_progress": 20, "mitigating": 45}
STEPS = {(a, b) for a, later in schema.LIFECYCLE.items() for b in later}


def plainly(opened, updates, deadlines, until=None):
    """(id, status, second, seq, previous, verdict, state, notice), one row at a time."""
    out = []
    for name, status, begun in opened:
        mine = sorted((u for u in updates if u[0] == name), key=lambda u: (u[2], u[3]))
        state, since, raw = status.lower(), begun, status
        out.append((name, status, begun, -1, None, "opened", state, "created"))

        def overdue(now):
            nonlocal state, since
            if state in deadlines and since + deadlines[state] < now:
                out.append((name, "escalated", since + deadlines[state], None, state, "overdue", "escalated", "escalated"))
                state, since = "escalated", since + deadlines[state]

        for _, to, second, seq in mine:
            now = max(second, begun)
            overdue(now)
            low = to.lower()
            verdict = "unchanged" if raw.lower() == low else "valid" if (raw.lower(), low) in STEPS else "rejected"
            told = None
            if (state, low) in STEPS:
                state, since = low, now
                told = low if low in ("resolved", "escalated") else "updated"
            out.append((name, to, second, seq, raw, verdict, state, told))
            raw = to
        overdue(10**9 if until is None else until)
    return sorted(out, key=str)


def frames(spark, opened, updates):
    a = spark.createDataFrame([(i, s, at(t)) for i, s, t in opened], OPENED)
    b = spark.createDataFrame([(i, s, at(t), n) for i, s, t, n in updates], UPDATES)
    return a, b


def got(df):
    second = (F.unix_micros("changed_at") / 1_000_000 - at().timestamp()).cast("bigint")
    rows = df.select("id", "status", second.alias("t"), "seq", "previous", "verdict", "state", "notice").collect()
    return sorted((tuple(r) for r in rows), key=str)


def made(rng, n_ids, n_updates, hot=0.0, early=0):
    words = [*schema.LIFECYCLE, "In_Progress", "strange", "open"]
    opened = [(f"i{k}", rng.choice(["open", "open", "Open", "strange"]), rng.randint(0, 200)) for k in range(n_ids)]
    updates = []
    for n in range(n_updates):
        k = 0 if rng.random() < hot else rng.randrange(n_ids)
        updates.append((f"i{k}", rng.choice([w for w in words if w != "resolved" or rng.random() < 0.1]),
                        opened[k][2] - early + rng.randint(0, 400), n))
    return opened, updates


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_judged_equals_a_plain_walk(spark, seed):
    opened, updates = made(random.Random(seed), 25, 200, early=30)
    found = lifecycle.judged(*frames(spark, opened, updates), deadlines_s=DEADLINES)
    assert got(found) == plainly(opened, updates, DEADLINES)


@pytest.mark.parametrize("seed, deadlines", [(4, DEADLINES), (5, {}), (6, {"open": 3, "in_progress": 2, "mitigating": 1})])
def test_one_incident_over_many_tasks(spark, seed, deadlines):
    """Most updates are of one incident that never ends, so tasks begin inside it."""
    rng = random.Random(seed)
    opened = [("i0", "open", 0), ("i1", "open", 5), ("i2", "open", 9)]
    words = ["in_progress", "investigating", "mitigating", "escalated", "open"]
    updates = [(rng.choice(["i0"] * 8 + ["i1", "i2"]), rng.choice(words), rng.randint(1, 900), n) for n in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = got(lifecycle.judged(*frames(spark, opened, updates), deadlines_s=deadlines))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == plainly(opened, updates, deadlines)


def test_long_silence_inside_one_incident_over_many_tasks(spark):
    """Rejected rows only: a deadline passes in a task that has no step to take."""
    opened = [("i0", "open", 0)]
    updates = [("i0", "open", 10 + n, n) for n in range(300)] + [("i0", "mitigating", 400 + n, 1000 + n) for n in range(50)]
    deadlines = {"open": 150}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = got(lifecycle.judged(*frames(spark, opened, updates), deadlines_s=deadlines))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == plainly(opened, updates, deadlines)
    assert sum(r[5] == "overdue" for r in found) == 1


def test_until_tells_how_far_time_has_gone(spark):
    opened, updates = [("a", "open", 0), ("b", "open", 100)], [("a", "in_progress", 10, 0)]
    until = int(at(60).timestamp()) * 1_000_000
    found = got(lifecycle.judged(*frames(spark, opened, updates), deadlines_s=DEADLINES, until_us=until))
    assert found == plainly(opened, updates, DEADLINES, until=60)
    assert [r[0] for r in found if r[5] == "overdue"] == ["a"]


def test_without_deadlines_it_is_transitions_and_strict_state(spark):
    opened, updates = frames(spark, *made(random.Random(9), 20, 150))
    steps = lifecycle.judged(opened, updates).cache()
    want = inc.transitions(inc.status_changes(opened, updates))
    names = ["id", "previous", "status", "changed_at", "seq", "verdict"]
    assert sorted(map(str, steps.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    last = streamed.latest_state(steps).select("id", "status")
    strict = inc.strict_state(opened, updates).select("id", "status")
    known = [*schema.LIFECYCLE]
    assert {r.id: r.status for r in last.collect() if r.status in known} == {
        r.id: r.status.lower() for r in strict.collect() if r.status.lower() in known}


def test_an_update_at_the_deadline_is_in_time(spark):
    opened, updates = [("a", "open", 0), ("b", "open", 0)], [("a", "in_progress", 30, 0), ("b", "mitigating", 30, 0)]
    found = got(lifecycle.judged(*frames(spark, opened, updates), deadlines_s={"open": 30}))
    assert [(r[0], r[2]) for r in found if r[5] == "overdue"] == [("b", 30)]


def test_empty_tables_and_odd_rows(spark):
    opened, updates = frames(spark, [], [])
    assert lifecycle.judged(opened, updates, deadlines_s=DEADLINES).collect() == []
    some, _ = frames(spark, [("a", "open", 0)], [])
    odd = spark.createDataFrame([("a", None, at(3), 0), ("a", "resolved", None, 1), (None, "open", at(2), 0), ("x", "open", at(1), 0)], UPDATES)
    found = lifecycle.judged(some, odd).collect()
    assert {r.id for r in found} == {"a"} and len(found) == 3
    assert {r.state for r in found if r.status == "resolved"} == {"resolved"}


@pytest.mark.parametrize("deadlines", [{"resolved": 5}, {"escalated": 5}, {"open": 0}, {"unheard": 9}])
def test_deadlines_that_cannot_end_a_state(deadlines):
    with pytest.raises(ValueError):
        lifecycle.Machine(None, deadlines)


# --- stream -----------------------------------------------------------------------


def stream_of(spark, path, opened, updates, files, lateness, rng):
    """The changes as files in time order, shuffled within the lateness."""
    rows = streamed.changes(*frames(spark, opened, updates)).collect()
    rows.sort(key=lambda r: r.changed_at.timestamp() + rng.random() * lateness)
    shape = "id string, status string, changed_at timestamp, seq bigint, opens int"
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], shape).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def to_the_end(spark, rows, root, **how):
    marks, out = f"{root}/marks", f"{root}/out"

    def run():
        steps = streamed.judged(pipeline.with_end_marks(rows, marks), "60 seconds", **how)
        pipeline.append(steps, out, "steps").awaitTermination()

    run()
    pipeline.end_mark(spark, rows.schema, marks, id="end", status="open", seq=-1, opens=0, changed_at=pipeline.END)
    run()
    return spark.read.parquet(f"{out}/steps")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    opened, updates = made(rng, 20, 120, early=0)
    updates.append(("ghost", "open", 20, 0))
    rows = stream_of(spark, str(tmp_path / "in"), opened, updates, 4, 50, rng)
    found = got(to_the_end(spark, rows, str(tmp_path), deadlines_s=DEADLINES))
    want = plainly(opened, updates, DEADLINES)
    assert [r for r in found if r[5] != "unknown"] == want
    assert [r[0] for r in found if r[5] == "unknown"] == ["ghost"]
    assert sum(r[5] == "overdue" for r in found) > 3


def test_rows_after_the_watermark_are_given_out_as_late(spark, tmp_path):
    shape = "id string, status string, changed_at timestamp, seq bigint, opens int"
    path = str(tmp_path / "in")
    batches = [
        [("a", "open", at(0), -1, 0), ("b", "open", at(1000), -1, 0)],
        [("c", "open", at(1001), -1, 0)],
        [("a", "resolved", at(5), 0, 1), ("c", "resolved", at(1002), 0, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    found = to_the_end(spark, rows, str(tmp_path))
    verdicts = {(r.id, r.status): (r.verdict, r.state) for r in found.collect()}
    assert verdicts[("a", "resolved")] == ("late", None)
    assert verdicts[("c", "resolved")] == ("valid", "resolved")


def test_finished_incidents_are_forgotten_if_asked(spark, tmp_path):
    shape = "id string, status string, changed_at timestamp, seq bigint, opens int"
    path = str(tmp_path / "in")
    for rows in ([("a", "open", at(0), -1, 0), ("a", "resolved", at(5), 0, 1)], [("b", "open", at(5000), -1, 0)],
                 [("b", "open", at(5001), 0, 1)], [("a", "open", at(6000), 1, 1)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    found = to_the_end(spark, rows, str(tmp_path), keep_s=600)
    assert {(r.id, r.verdict) for r in found.collect()} >= {("a", "opened"), ("a", "valid"), ("a", "unknown")}


def test_incidents_share_the_state_of_a_bucket(spark, tmp_path):
    """Calls to the state, timers among them, do not grow with the incidents; a number
    beside an escalation stays whole."""
    rng = random.Random(12)
    opened, updates = made(rng, 60, 200)
    big = 2**53 + 1
    updates = [(name, to, second, big + n) for name, to, second, n in updates]
    rows = pipeline.with_end_marks(
        stream_of(spark, str(tmp_path / "in"), opened, updates, 1, 0, rng), str(tmp_path / "marks"))
    for end in (False, True):
        if end:
            pipeline.end_mark(spark, rows.schema, str(tmp_path / "marks"), id="end", status="open", seq=-1, opens=0, changed_at=pipeline.END)
        steps = streamed.judged(rows, "60 seconds", deadlines_s=DEADLINES, buckets=3)
        query = pipeline.append(steps, str(tmp_path), "steps")
        query.awaitTermination()
        timers = [s["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for s in p["stateOperators"]]
        assert 0 < max(timers) <= 12
    found = got(spark.read.parquet(f"{tmp_path}/steps"))
    assert found == plainly(opened, updates, DEADLINES)
    assert sum(r[5] == "overdue" for r in found) > 3
