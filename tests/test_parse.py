import json

import pytest
from pyspark.sql import functions as F

from vigilog.operators import parse, process
from vigilog.sources import tables

EVENT = {
    "event_id": "evt-1", "timestamp": "2026-03-08T16:10:01.000Z", "service_name": "api-gateway",
    "log_level": "ERROR", "event_type": "http.request", "message": "m",
    "metadata": {"status": 500, "latency_ms": 300, "client_ip": "10.0.1.45"},
}


def line(drop=(), **changes):
    return json.dumps({k: v for k, v in {**EVENT, **changes}.items() if k not in drop})


@pytest.mark.parametrize(
    "text, reason",
    [
        (line(), None),
        ("  " + line() + " \r", None),
        ("", "empty"),
        ("   \t", "empty"),
        ('{"event_id": "evt', "malformed"),
        ("not json", "malformed"),
        (line() + " more", "malformed"),
        (line() + line(), "malformed"),
        (line() + "," + line(), "malformed"),
        (line() + "]", "malformed"),
        (line()[:-1] + ', "event_id": "evt-2"}', None),
        ("42", "not_object"),
        ("[1, 2]", "not_object"),
        ('"text"', "not_object"),
        (line(drop=["log_level"]), "missing_field"),
        (line(log_level=None), None),
        (line(event_type=None), None),
        (line(drop=["metadata"]), "no_metadata"),
        (line(metadata=None), "no_metadata"),
        (line(metadata=[1]), "no_metadata"),
        (line(metadata={}), None),
        (line(metadata={"status": "500"}), "bad_type"),
        (line(metadata={"status": None, "latency_ms": None}), None),
        (line(event_type="db.query", metadata={"status": "x"}), None),
        (line(event_type="db.query", metadata={"latency_ms": "slow"}), "bad_type"),
        (line(event_type="db.query", metadata={"latency_ms": ""}), None),
        (line(event_type="db.query", metadata={"latency_ms": 12.5}), None),
    ],
)
def test_reject_reason(spark, text, reason):
    df = spark.createDataFrame([(text,)], "value string")
    assert parse.parse_json_lines(df).first().reject_reason == reason


def test_typed_columns_and_stamps(spark):
    df = spark.createDataFrame([(line(), "a.log")], "value string, source_file string")
    row = parse.accepted(parse.parse_json_lines(df)).first()
    assert (row.status, row.latency_ms, row.client_ip) == (500.0, 300.0, "10.0.1.45")
    assert row.ingestion_source_file == "a.log"
    assert row.ingested_at is not None
    assert row.timestamp.isoformat().startswith("2026-03-08T16:10:01")


@pytest.mark.parametrize(
    "text, micros",
    [
        ("2026-03-08T16:10:01.000Z", 1772986201000000),
        ("2026-03-08T16:10:01.123456", 1772986201123456),
        ("2026-03-08T18:10:01+02:00", 1772986201000000),
        ("yesterday", None),
    ],
)
def test_timestamps(spark, text, micros):
    df = spark.createDataFrame([(line(timestamp=text),)], "value string")
    out = parse.accepted(parse.parse_json_lines(df)).select(F.unix_micros("timestamp")).first()
    assert out[0] == micros


def test_contract(spark):
    lines = [line(), line(timestamp="no"), line(log_level="LOUD"), line(log_level=None)]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    rows = parse.enforce_contract(parse.accepted(parse.parse_json_lines(df))).collect()
    assert [r.reject_reason for r in rows] == [None, "bad_timestamp", "bad_level", None]


def test_lines_are_either_kept_or_refused(spark):
    texts = [line(), "", "42", line(drop=["event_id"]), line(metadata={})]
    parsed = parse.parse_json_lines(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert parse.accepted(parsed).count() == 2
    assert sorted(r.reason for r in parse.dead_letters(parsed).collect()) == [
        "empty", "missing_field", "not_object"]
    status = process.classify_status(parsed).groupBy("_status").count().collect()
    assert dict(status) == {"processed": 2, "dropped": 3}


def test_counts_are_observed(spark):
    from pyspark.sql import Observation

    parsed = parse.parse_json_lines(spark.createDataFrame([(line(),), ("x",)], "value string"))
    seen = Observation("ingest")
    process.classify_status(parsed, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 1, "dropped": 1}


def test_free_text_formats(spark):
    texts = [
        "2026-03-08T16:10:01.000Z ERROR db-monitor [db.query] slow one latency_ms=3500 x=1",
        '10.0.0.7 - - [2026-03-08T16:10:01.000Z] "GET /api/v1/users" 503 12.5',
        "nothing known",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    a, b, c = parse.parse_text_lines(df).collect()
    assert (a.pattern, a.service_name, a.event_type, a.log_level, a.latency_ms) == (
        "service_line", "db-monitor", "db.query", "ERROR", 3500.0)
    assert (b.pattern, b.service_name, b.event_type, b.log_level, b.status, b.path, b.client_ip) == (
        "access_line", "api-gateway", "http.request", "ERROR", 503.0, "/api/v1/users", "10.0.0.7")
    assert c.pattern is None and c.log_level is None
    assert a.timestamp == b.timestamp


def test_log_files_only(spark, tmp_path):
    (tmp_path / "a.log").write_text(line() + "\n" + "\n")
    (tmp_path / "b.txt").write_text(line() + "\n")
    rows = tables.read_log_files(spark, str(tmp_path)).collect()
    assert [r.source_file for r in rows] == ["a.log", "a.log"]


def test_json_is_decoded_once_per_row(spark):
    df = spark.createDataFrame([(line(),)], "value string")
    plan = parse.accepted(parse.parse_json_lines(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
