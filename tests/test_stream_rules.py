"""Rules from a table that changes while a stream runs."""

import random

import pytest

from vigilog import schema
from vigilog.operators import rulebook
from vigilog.streaming import rulebook as on_stream
from helpers import LOG_DDL, at

SECOND = 1_000_000


def rule(rule_id, version, since, threshold=None, signal="SLOW", window_s=None, count=None, key=None, kind="http.request",
         severity="HIGH"):
    field = "latency_ms" if threshold is not None else None
    return (rule_id, version, at(since), kind, field, ">" if field else None, threshold, signal, severity, window_s, count,
            key, None)


def events(rng, n, span):
    times = [int(rng.random() * span) for _ in range(n)]  # with ties
    return [{"event_id": f"e{i:05d}", "event_type": "http.request", "timestamp": at(t),
             "latency_ms": float(rng.randrange(100)), "client_ip": rng.choice(["1.1.1.1"] * 3 + ["2.2.2.2", "", None])}
            for i, t in enumerate(times)]


@pytest.fixture
def run(spark, make_logs, tmp_path):
    """Feeds parts of a stream, each with the rule table of its time."""
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")

    def feed_and_judge(rows, rules, lateness_s=60, files=2):
        size = -(-len(rows) // files)
        for i in range(files):
            make_logs(rows[i * size:(i + 1) * size]).coalesce(1).write.mode("append").parquet(feed)
        table = spark.createDataFrame(rules, schema.RULE_SCHEMA)
        logs = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 1).parquet(feed)
        on_stream.signals_while_rules_change(logs, lambda: table, root, lateness_s * SECOND).awaitTermination()

    feed_and_judge.root = root
    return feed_and_judge


def digest(df):
    return sorted((r.rule_id, r.version, r.signal_type, r.event_id) for r in df.collect())


def both_kinds(logs, rules):
    return rulebook.evaluate(logs, rules).unionByName(rulebook.evaluate_windows(logs, rules))


def all_signals(spark, root):
    return on_stream.read_signals(spark, root).unionByName(on_stream.remaining_signals(spark, root))


def arrival(rows, rng, lateness_s):
    return sorted(rows, key=lambda r: r["timestamp"].timestamp() + rng.random() * lateness_s)


@pytest.mark.parametrize("seed", [1])
def test_stream_over_rule_changes_equals_batch(spark, make_logs, run, seed):
    rng = random.Random(seed)
    first = [rule("slow", 1, 0, 80.0), rule("many", 1, 0, 50.0, "MANY", 30, 3, "client_ip"),
             rule("all", 1, 0, 70.0, "ALL", 40, 4)]
    # Another threshold, another window, another kind, a new rule.
    second = [*first, rule("slow", 2, 600, 90.0), rule("many", 2, 650, 40.0, "MANY", 60, 5, "client_ip"),
              rule("all", 2, 620, 95.0, "ALL"), rule("new", 1, 700, None, "NEW", 20, 6)]
    rows = events(rng, 600, 1200)
    early = arrival([r for r in rows if r["timestamp"] < at(590)], rng, 50)
    later = arrival([r for r in rows if r["timestamp"] >= at(590)], rng, 50)
    run(early, first)
    run(later, second)
    want = both_kinds(make_logs(rows), spark.createDataFrame(second, schema.RULE_SCHEMA))
    got = all_signals(spark, run.root)
    assert digest(got) == digest(want)
    assert {(r.rule_id, r.version) for r in got.collect()} >= {(n, v) for n in ("slow", "many", "all") for v in (1, 2)}
    assert on_stream.late_rules(spark, run.root).count() == on_stream.refused_rules(spark, run.root).count() == 0
    assert spark.read.parquet(f"{run.root}/late").count() == 0


def test_counts_go_on_over_micro_batches_and_end_with_their_version(spark, make_logs, run):
    def hits(*seconds):
        return [{"event_id": f"h{s:04d}", "event_type": "http.request", "timestamp": at(s)} for s in seconds]

    one = rule("r", 1, 0, None, "HITS", 100, 3)
    two = rule("r", 2, 50, None, "HITS", 100, 3)
    run(hits(10, 20), [one], lateness_s=5, files=1)
    run(hits(30, 40, 45), [one, two], lateness_s=5, files=1)
    run(hits(51, 52), [one, two], lateness_s=5, files=1)
    run(hits(53, 300), [one, two], lateness_s=5, files=1)
    # 10 20 30 are of version 1, then 40 45 are left over; version 2 begins at none.
    assert digest(all_signals(spark, run.root)) == [("r", 1, "HITS", "h0030"), ("r", 2, "HITS", "h0053")]


def test_a_version_published_late_begins_after_what_is_judged(spark, make_logs, run):
    rng = random.Random(7)
    rows = sorted(events(rng, 300, 1000), key=lambda r: r["timestamp"])
    early, later = rows[:150], rows[150:]
    run(early, [rule("slow", 1, 0, 80.0), rule("slow", 3, 100, 60.0)], files=1)
    # Version 2 has its time behind it, version 4 a part of it; "back" is wholly new.
    run(later, [rule("slow", 2, 50, 10.0), rule("slow", 4, 200, 95.0), rule("back", 1, 0, 50.0, "BACK", 30, 2)])
    used = on_stream.rules_in_force(spark, run.root)
    assert digest(all_signals(spark, run.root)) == digest(both_kinds(make_logs(rows), used))
    begins = {(r.rule_id, r.version): r.valid_from for r in used.collect()}
    edge = early[-1]["timestamp"].replace(tzinfo=None)
    assert set(begins) == {("slow", 1), ("slow", 3), ("slow", 4), ("back", 1)}
    assert all((begins[k] - edge).total_seconds() == 1e-6 for k in (("slow", 4), ("back", 1)))
    late = {(r.rule_id, r.version): r.state for r in on_stream.late_rules(spark, run.root).collect()}
    assert late == {("slow", 2): "superseded", ("slow", 4): "in force", ("back", 1): "in force"}


def test_versions_removed_changed_or_invalid_do_not_stop_the_stream(spark, make_logs, run):
    rng = random.Random(3)
    rows = sorted(events(rng, 200, 400), key=lambda r: r["timestamp"])
    good = rule("slow", 1, 0, 80.0)
    run(rows[:100], [good, good, rule("bad", 1, 0, None, "BAD", 0, 3), rule("bad", 2, 0, 5.0, "BAD", 10, None)])
    run(rows[100:], [rule("slow", 1, 0, 10.0), rule("bad", 1, 0, None, "BAD", 0, 3)])
    got = all_signals(spark, run.root)
    assert digest(got) == digest(rulebook.evaluate(make_logs(rows), spark.createDataFrame([good], schema.RULE_SCHEMA)))
    refused = sorted((r.rule_id, r.version, r.problem) for r in on_stream.refused_rules(spark, run.root).collect())
    assert refused == [("bad", 1, "window_s not above 0"), ("bad", 2, "count not at least 1"),
                       ("slow", 1, "version says something else")]


def test_a_batch_that_is_run_again_changes_nothing(spark, make_logs, tmp_path):
    rng = random.Random(9)
    root = str(tmp_path)
    rows = sorted(events(rng, 240, 500), key=lambda r: r["timestamp"])
    # Copies of an event count one by one.
    rows = sorted(rows + rows[::3] + rows[::3], key=lambda r: r["timestamp"])
    rules = [rule("many", 1, 0, 50.0, "MANY", 30, 4, "client_ip"), rule("all", 1, 0, 20.0, "ALL", 60, 3)]
    table = spark.createDataFrame(rules, schema.RULE_SCHEMA)
    for number, start in enumerate(range(0, len(rows), 220)):
        batch = make_logs(rows[start:start + 220])
        for _ in range(2):
            on_stream.judge_batch(batch, number, lambda: table, root, 20 * SECOND)
    got, want = all_signals(spark, root), rulebook.evaluate_windows(make_logs(rows), table)
    assert digest(got) == digest(want) and got.count() > 20


def test_rows_behind_the_horizon_are_kept_apart(spark, make_logs, run):
    def hit(name, second):
        return {"event_id": name, "event_type": "http.request", "timestamp": at(second), "latency_ms": 90.0}

    rules = [rule("slow", 1, 0, 80.0), rule("all", 1, 0, None, "ALL", 100, 2)]
    run([hit("a", 10)], rules, lateness_s=5, files=1)
    run([hit("b", 200)], rules, lateness_s=5, files=1)
    run([hit("late", 11), {"event_id": "none", "event_type": "http.request", "timestamp": None}], rules, lateness_s=5, files=1)
    assert [r.event_id for r in spark.read.parquet(f"{run.root}/late").collect()] == ["late"]
    assert digest(all_signals(spark, run.root)) == [("slow", 1, "SLOW", n) for n in ("a", "b", "late")]


def test_no_rules_and_no_rows(spark, make_logs, run):
    assert on_stream.remaining_signals(spark, run.root) is None
    assert on_stream.rules_in_force(spark, run.root).count() == on_stream.late_rules(spark, run.root).count() == 0
    run([{"event_id": "a", "event_type": "http.request"}], [], files=1)
    assert all_signals(spark, run.root).count() == 0
    assert on_stream.refused_rules(spark, run.root).columns[-1] == "problem"
