import pytest

from vigilog.operators import process, search
from vigilog.sources import tables
from helpers import at


@pytest.mark.parametrize(
    "event_type, status, expected",
    [
        ("auth.login_failed", None, ("AUTH_FAILURE", "HIGH")),
        ("auth.login_failed", 500, ("AUTH_FAILURE", "HIGH")),
        ("http.request", None, ("HTTP_SUCCESS", "LOW")),
        ("http.request", 399, ("HTTP_SUCCESS", "LOW")),
        ("http.request", 400, ("HTTP_CLIENT_ERROR", "MEDIUM")),
        ("http.request", 499, ("HTTP_CLIENT_ERROR", "MEDIUM")),
        ("http.request", 499.5, ("HTTP_CLIENT_ERROR", "MEDIUM")),
        ("http.request", 500, ("HTTP_ERROR", "HIGH")),
        ("db.query", 500, ("db.query", "LOW")),
        (None, 500, (None, "LOW")),
    ],
)
def test_normalise(make_logs, event_type, status, expected):
    status = None if status is None else float(status)
    row = process.process_logs(make_logs([{"event_type": event_type, "status": status}])).first()
    assert (row.normalized_type, row.severity) == expected


@pytest.mark.parametrize(
    "latency, bucket",
    [(None, None), (0.0, None), (-5.0, "LOW"), (1.0, "LOW"), (200.0, "LOW"), (200.5, "MEDIUM"),
     (201.0, "MEDIUM"), (1000.0, "MEDIUM"), (1001.0, "HIGH")],
)
def test_latency_bucket(make_logs, latency, bucket):
    row = process.process_logs(make_logs([{"event_type": "db.query", "latency_ms": latency}])).first()
    assert row.features.latency_bucket == bucket
    assert row.features.service == "api-gateway"
    assert (row.region, row.cluster) == ("us-east-1", "prod-cluster")


def test_views(make_logs):
    from pyspark.sql import functions as F

    logs = make_logs([{"event_type": "db.query"}]).withColumn("metadata", F.lit("{}"))
    assert len(process.raw_view(logs).columns) == 8
    assert len(process.normalised_view(process.process_logs(logs)).columns) == 7


def test_nested_get_with_default(spark):
    from pyspark.sql import functions as F

    from vigilog.functions import fields

    rows = spark.createDataFrame([('{"a": {"n": 5}}',), ('{"a": {"n": null}}',), ("{}",)], "v string")
    got = rows.select(fields.get_or(F.parse_json("v"), "$.a.n", "int", 200)).collect()
    assert [r[0] for r in got] == [5, 200, 200]


def test_search(make_logs):
    logs = make_logs(
        [
            {"event_type": "db.query", "timestamp": at(0), "message": "Timeout here"},
            {"event_type": "db.query", "timestamp": at(10), "message": "fine"},
            {"event_type": "http.request", "timestamp": at(20), "message": "timeout"},
        ]
    )
    found = search.search_logs(logs, event_type="db.query", contains="timeout")
    assert [r.event_id for r in found.collect()] == ["e0000"]
    found = search.search_logs(logs, since=at(10), until=at(20))
    assert [r.event_id for r in found.collect()] == ["e0001"]
    assert search.search_logs(logs, service="none").count() == 0


def test_time_filters_skip_days(spark, make_logs, tmp_path):
    logs = make_logs([{"event_type": "x", "timestamp": at(86400 * d)} for d in range(5)])
    path = str(tmp_path / "t")
    tables.write_by_day(logs, path)
    found = search.search_logs(tables.read_table(spark, path), since=at(86400), until=at(86400 * 3))
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "day" in filters[: filters.index("]")]


def test_replay_gives_the_same_ids(make_logs):
    from vigilog.operators import rules

    logs = make_logs([{"event_type": "deployment.failed", "timestamp": at(s)} for s in range(5)])
    again = search.replay(logs, at(1), at(3), rules.event_signals)
    first = {r.event_id: r.signal_id for r in rules.event_signals(logs).collect()}
    got = {r.event_id: r.signal_id for r in again.collect()}
    assert got == {e: first[e] for e in ("e0001", "e0002")}


def test_messages_round_trip(make_logs):
    from vigilog import schema
    from vigilog.operators import rules

    signals = rules.event_signals(make_logs([{"event_type": "deployment.failed", "version": "v1"}]))
    sent = tables.as_messages(signals, "signal_id")
    back = tables.from_messages(sent, schema.SIGNAL_SCHEMA).first()
    want = signals.first()
    assert sent.columns == ["key", "value"]
    assert (back.signal_id, back.signal_type, back.detected_at) == (
        want.signal_id, want.signal_type, want.detected_at)
    assert back.metadata["version"] == "v1"
