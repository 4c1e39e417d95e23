"""Anomalies over dense time, in batch and on a stream, against a plain walk."""

import math
import random

import pytest

from vigilog.operators import anomaly
from vigilog.streaming import anomaly as on_stream
from helpers import at

W = 60_000_000
BASE = int(at().timestamp()) // 60 * 60  # start of the first window, in seconds
OFFSET = BASE - int(at().timestamp())


def log(service, minute, second=0.0, error=False):
    return {"service_name": service, "event_type": "t", "timestamp": at(OFFSET + minute * 60 + second),
            "log_level": "ERROR" if error else "INFO"}


def brute_force(rows, history, threshold, value):
    """Every window from a service's first to the last of all."""
    counts = {}
    for r in rows:
        w = int(r["timestamp"].timestamp()) // 60
        one = counts.setdefault(r["service_name"], {}).setdefault(w, [0, 0])
        one[0] += 1
        one[1] += r["log_level"] == "ERROR"
    last = max(w for c in counts.values() for w in c)
    out = set()
    for service, c in counts.items():
        first = min(c)
        series = [c.get(w, [0, 0])[value] for w in range(first, last + 1)]
        for i, x in enumerate(series):
            past = series[max(0, i - history):i]
            z = mean = None
            if past:
                mean = round(sum(past) / len(past), 6)
                std = round(math.sqrt(sum((p - sum(past) / len(past)) ** 2 for p in past) / len(past)), 6)
                z = round((x - mean) / std, 4) if std > 0 else None
            flags = (z is not None and abs(z) > 2, mean is not None and x > mean * 3, x > threshold)
            if any(flags):
                out.add((service, first + i, x, z, flags))
    return out


def flags(df, value):
    return {(r.service_name, r.window_start_us // W, r[value], None if r.zscore is None else round(r.zscore, 4),
             (r.is_zscore, r.is_moving_avg, r.is_threshold)) for r in anomaly.flagged(df).collect()}


def some(rng, n):
    # With silences longer and shorter than the history.
    minutes = [m for m in range(80) if not (20 <= m < 24 or 40 <= m < 55)]
    return [log(rng.choice(["a", "a", "b", None]), rng.choice(minutes), rng.randrange(60), rng.random() < 0.3)
            for _ in range(n)]


@pytest.mark.parametrize("value", [0, 1])
def test_silent_windows_count(make_logs, value):
    rows = some(random.Random(value), 300)
    name = ("events", "errors")[value]
    rates = anomaly.error_rate(make_logs(rows + [{**log("a", 1), "timestamp": None}]), W)
    scored = anomaly.dense_anomalies(rates, W, history=6, threshold=3, value=name)
    want = brute_force(rows, 6, 3, value)
    assert flags(scored, name) == want and len(want) > 5
    if name == "events":
        assert any(x == 0 for _, _, x, _, _ in want)  # a service that went silent


def test_a_long_silence_is_not_filled_for_ever(make_logs):
    rows = [log("a", 0), log("a", 1), log("a", 1_000_000, error=True)]
    scored = anomaly.dense_anomalies(anomaly.error_rate(make_logs(rows), W), W, history=5)
    assert scored.count() == 2 + 5 + 1
    (one,) = anomaly.flagged(scored).collect()
    assert (one.errors, one.moving_avg, one.zscore) == (1, 0.0, None)


def test_no_rows_and_thresholds_below_zero(make_logs):
    rates = anomaly.error_rate(make_logs([]), W)
    assert anomaly.dense_anomalies(rates, W).count() == 0
    with pytest.raises(ValueError):
        anomaly.dense_anomalies(rates, W, threshold=-1)


def test_stream_equals_batch(spark, make_logs, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    rows = some(rng, 260)
    watch = on_stream.Watch(W, 4 * W, 6, {"threshold": 3, "value": "events"})
    late = sorted(rows, key=lambda r: r["timestamp"].timestamp() + rng.random() * 200)
    for number in range(4):
        part = make_logs(late[number * 65:(number + 1) * 65])
        for _ in range(2 if number == 2 else 1):  # once again, as after a failure
            on_stream.watch_batch(part, number, root, watch)
    closed = on_stream.scored(spark, root)
    assert closed.groupBy("service_name", "window_start_us").count().filter("count > 1").count() == 0
    got = closed.unionByName(on_stream.remaining(spark, root, watch))
    want = brute_force(rows, 6, 3, 0)
    assert flags(got, "events") == want and len(want) > 5
    assert spark.read.parquet(f"{root}/late").count() == 0
    # Open windows, those of the history and one row for each service are kept.
    assert spark.read.parquet(f"{root}/kept/slot=1").filter("events > 0").count() <= 3 * (6 + 5)


def test_events_of_judged_windows_are_kept_apart(spark, make_logs, tmp_path):
    root, watch = str(tmp_path), on_stream.Watch(W, W, 6)
    with pytest.raises(ValueError, match="no micro-batch"):
        on_stream.scored(spark, root)
    on_stream.watch_batch(make_logs([]), 0, root, watch)
    assert on_stream.scored(spark, root).count() == on_stream.remaining(spark, root, watch).count() == 0
    on_stream.watch_batch(make_logs([log("a", 10)]), 1, root, watch)
    on_stream.watch_batch(make_logs([log("a", 3, error=True), log("a", 9), log("b", 8)]), 2, root, watch)
    late = {(r.service_name, r.window_start_us // W - BASE // 60, r.errors) for r in spark.read.parquet(f"{root}/late").collect()}
    assert late == {("a", 3, 1), ("b", 8, 0)}
    found = on_stream.scored(spark, root).unionByName(on_stream.remaining(spark, root, watch))
    assert {(r.service_name, r.window_start_us // W - BASE // 60) for r in found.collect()} == {("a", 9), ("a", 10)}
