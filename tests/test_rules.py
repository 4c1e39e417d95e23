from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators import rulebook, rules, windows
from helpers import at


def login(i, ip="192.168.1.99", seconds=0.0):
    return {"event_type": "auth.login_failed", "service_name": "auth-service", "client_ip": ip,
            "event_id": f"l{i:03d}", "timestamp": at(seconds)}


def error(i, seconds=0.0, service="api-gateway", latency=300.0):
    return {"event_type": "http.request", "status": 500.0, "latency_ms": latency,
            "service_name": service, "event_id": f"h{i:03d}", "timestamp": at(seconds)}


def found(logs):
    rows = rules.detect(logs).orderBy("detected_at", "event_id", "rule_order").collect()
    return [(r.signal_type, r.severity, r.event_id, r.metadata) for r in rows]


def test_sample_events(make_logs):
    """One single error, a slow request, five login failures that share id and
    time, a failed deployment, a slow query."""
    same = {**login(3), "timestamp": at(3)}
    logs = make_logs(
        [
            error(1, 1),
            {"event_type": "http.request", "status": 200.0, "latency_ms": 3500.0,
             "event_id": "e2", "timestamp": at(2)},
            same, same, same, same, same,
            {"event_type": "deployment.failed", "version": "v2.4.1", "reason": "container_crash",
             "event_id": "e4", "timestamp": at(4)},
            {"event_type": "db.query", "latency_ms": 3500.0, "event_id": "e5", "timestamp": at(5)},
        ]
    )
    assert found(logs) == [
        ("HIGH_LATENCY", "MEDIUM", "e2", {"latency_ms": "3500"}),
        ("BRUTE_FORCE_LOGIN", "HIGH", "l003", {"ip": "192.168.1.99"}),
        ("DEPLOYMENT_FAILURE", "HIGH", "e4", {"version": "v2.4.1", "reason": "container_crash"}),
        ("DB_SLOW_QUERY", "MEDIUM", "e5", {"latency_ms": "3500"}),
    ]


@pytest.mark.parametrize(
    "event_type, latency, fires",
    [("http.request", 2000, 0), ("http.request", 2001, 1), ("http.request", None, 0),
     ("db.query", 3000, 0), ("db.query", 3001, 1), ("db.slow_query", 9000, 0),
     ("auth.login_failed", 9000, 0)],
)
def test_thresholds(make_logs, event_type, latency, fires):
    value = None if latency is None else float(latency)
    logs = make_logs([{"event_type": event_type, "latency_ms": value}])
    assert rules.event_signals(logs).count() == fires


def test_deployment_evidence_keeps_nulls(make_logs):
    row = rules.event_signals(make_logs([{"event_type": "deployment.failed"}])).first()
    assert row.metadata == {"version": None, "reason": None}


@pytest.mark.parametrize("span, fires", [(60, 1), (60.000001, 0)])
def test_login_window_edge(make_logs, span, fires):
    logs = make_logs([login(i, seconds=i * span / 4) for i in range(4)] + [login(9, seconds=span)])
    assert len(found(logs)) == fires


@pytest.mark.parametrize("span, fires", [(30, 1), (30.000001, 0)])
def test_error_window_edge(make_logs, span, fires):
    logs = make_logs([error(i, i) for i in range(9)] + [error(99, span)])
    assert len(found(logs)) == fires


def test_spike_counts_across_services(make_logs):
    logs = make_logs([error(i, i, "a" if i % 2 else "b") for i in range(10)])
    signal = rules.detect(logs).first()
    assert (signal.service, signal.metadata) == ("a", {"count": "10"})
    by_service = rules.error_spike_rule(key=("service_name",))
    assert rules.detect(logs, windowed=[by_service]).count() == 0


def test_addresses_count_alone(make_logs):
    rows = [login(i, "1.1.1.1", i) for i in range(4)] + [login(i + 10, "2.2.2.2", i) for i in range(4)]
    assert found(make_logs(rows)) == []
    assert found(make_logs([login(i, "", i) for i in range(9)] + [login(50 + i, None, i) for i in range(9)])) == []


def test_one_event_may_give_two_signals(make_logs):
    logs = make_logs([error(i, i) for i in range(9)] + [error(9, 9, latency=3500.0)])
    assert [s[0] for s in found(logs)] == ["HTTP_ERROR_SPIKE", "HIGH_LATENCY"]
    listed = rules.signals_per_event(logs, rules.detect(logs)).filter(F.size("signals") > 0).collect()
    assert [[s.signal_type for s in r.signals] for r in listed] == [["HTTP_ERROR_SPIKE", "HIGH_LATENCY"]]


def test_copies_of_an_event_share_one_list(make_logs):
    slow = {"event_type": "http.request", "latency_ms": 9000.0, "event_id": "same"}
    logs = make_logs([slow] * 300)
    listed = rules.signals_per_event(logs, rules.event_signals(logs)).collect()
    assert len(listed) == 300 and all(len(r.signals) == 1 for r in listed)


def test_context_columns_come_along(make_logs):
    logs = make_logs([{**login(i, seconds=i), "trace_id": f"t{i}"} for i in range(5)])
    row = rules.detect(logs, context=("trace_id",)).first()
    assert (row.event_id, row.trace_id) == ("l004", "t4")


def test_ids_repeat_on_replay(make_logs):
    logs = make_logs([login(i, seconds=i) for i in range(10)])
    first, again = rules.detect(logs), rules.detect(logs)
    assert {r.signal_id for r in first.collect()} == {r.signal_id for r in again.collect()}


def test_event_rules_take_one_pass(make_logs):
    plan = rules.event_signals(make_logs([error(1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_rules_reach_the_scan(spark, make_logs, tmp_path):
    """Event types are filtered in the file scan, and only used columns read."""
    make_logs([error(1)]).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "9999")
    logs = spark.read.parquet(str(tmp_path / "t"))
    plan = rules.event_signals(logs)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "In(event_type" in pushed
    read = plan[plan.index("ReadSchema"):]
    assert "message" not in read and "client_ip" not in read and "latency_ms" in read
    one = rules.event_signals(logs, [rules.latency_rule()])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(latency_ms,2000.0)" in plan


def rule_row(rule_id, version, valid_from, event_type, field=None, op=None, threshold=None,
             signal="S", severity="LOW", window_s=None, count=None, key=None, text=None):
    return (rule_id, version, valid_from, event_type, field, op, threshold, signal, severity,
            window_s, count, key, text)


def test_rule_versions_apply_as_of(spark, make_logs):
    table = spark.createDataFrame(
        [rule_row("r", 1, at(0), "db.query", "latency_ms", ">", 10.0),
         rule_row("r", 2, at(10), "db.query", "latency_ms", ">", 100.0)], schema.RULE_SCHEMA)
    logs = make_logs([{"event_type": "db.query", "latency_ms": 50.0, "timestamp": at(s)}
                      for s in (-1, 0, 9.999999, 10, 11)])
    rows = rulebook.evaluate(logs, table).orderBy("event_id").collect()
    assert [(r.event_id, r.version, r.metadata) for r in rows] == [
        ("e0001", 1, {"latency_ms": "50"}), ("e0002", 1, {"latency_ms": "50"})]


@pytest.mark.parametrize("op, hits", [(">", 1), (">=", 2), ("<", 1), ("<=", 2), ("=", 1), ("<>", 2)])
def test_rule_comparisons(spark, make_logs, op, hits):
    table = spark.createDataFrame(
        [rule_row("r", 1, at(-9), "db.query", "latency_ms", op, 10.0)], schema.RULE_SCHEMA)
    logs = make_logs([{"event_type": "db.query", "latency_ms": v} for v in (9.0, 10.0, 11.0, None)])
    assert rulebook.evaluate(logs, table).count() == hits


def test_window_rules_from_table(spark, make_logs):
    table = spark.createDataFrame(
        [rule_row("w", 1, at(-9), "auth.login_failed", window_s=60, count=5, key="client_ip",
                  signal="BRUTE_FORCE_LOGIN", severity="HIGH")], schema.RULE_SCHEMA)
    logs = make_logs([login(i, seconds=i) for i in range(5)])
    row = rulebook.evaluate_windows(logs, table).first()
    assert (row.event_id, row.metadata, row.rule_id) == ("l004", {"client_ip": "192.168.1.99"}, "w")


def test_open_ended_validity(spark):
    table = spark.createDataFrame(
        [rule_row("a", 1, at(0), "x"), rule_row("a", 2, at(5), "x")], schema.RULE_SCHEMA)
    ends = {r.version: r.valid_to for r in rulebook.validity(table).collect()}
    assert ends[2] is None and ends[1] - timedelta(0) == at(5).replace(tzinfo=None)


RULES = (
    "rule_id string, version int, valid_from timestamp, event_type string, field string, op string, threshold double, "
    "threshold_text string, signal_type string, severity string, count int, window_s int, key_field string"
)


def test_rules_on_text_fields(spark, make_logs):
    logs = make_logs([{"event_type": "x", "reason": r, "latency_ms": m} for r, m in (("oom", 1.0), ("disk", 1e19), (None, None))])
    rows = [("t", 1, at(-9), "x", "reason", "=", None, "oom", "T", "LOW", None, None, None),
            ("n", 1, at(-9), "x", "reason", "!=", None, "oom", "N", "LOW", None, None, None),
            ("big", 1, at(-9), "x", "latency_ms", ">", 5.0, None, "B", "LOW", None, None, None)]
    found = rulebook.evaluate(logs, spark.createDataFrame(rows, RULES)).collect()
    assert sorted((r.rule_id, *r.metadata.items()) for r in found) == [
        ("big", ("latency_ms", "1.0E19")), ("n", ("reason", "disk")), ("t", ("reason", "oom"))]


def test_invalid_rules_are_refused(spark, make_logs):
    good = ("ok", 1, at(-9), "x", "latency_ms", ">", 5.0, None, "T", "LOW", None, None, None)
    bad = [("a", 1, at(-9), "x", "colour", "=", 1.0, None), ("b", 1, at(-9), "x", "latency_ms", "~", 1.0, None),
           ("c", 1, at(-9), "x", "reason", "=", 1.0, None), ("d", 1, at(-9), "x", "status", ">", None, "9"),
           ("e", 1, at(-9), None, None, None, None, None)]
    rules_ = spark.createDataFrame([good, *[(*b, "T", "LOW", None, None, None) for b in bad]], RULES)
    assert {r.rule_id: r.problem for r in rulebook.rejected_rules(rules_).collect()} == {
        "a": "unknown field", "b": "unknown op", "c": "no threshold_text", "d": "no threshold", "e": "no event_type"}
    with pytest.raises(ValueError, match="unknown"):
        rulebook.evaluate(make_logs([{"event_type": "x"}]), rules_.filter("rule_id in ('a', 'ok')"))


def test_a_rule_may_change_its_kind(spark, make_logs):
    table = spark.createDataFrame(
        [rule_row("r", 1, at(0), "x"), rule_row("r", 2, at(10), "x", window_s=60, count=2, signal="W"),
         rule_row("r", 3, at(20), "x")], schema.RULE_SCHEMA)
    logs = make_logs([{"event_type": "x", "timestamp": at(s)} for s in (1, 11, 12, 21)])
    assert [(r.event_id, r.version) for r in rulebook.evaluate(logs, table).orderBy("event_id").collect()] == [
        ("e0000", 1), ("e0003", 3)]
    row, = rulebook.evaluate_windows(logs, table).collect()
    assert (row.event_id, row.version, row.metadata) == ("e0002", 2, {"count": "2"})


def test_no_rules_no_signals(spark, make_logs):
    logs = make_logs([{"event_type": "x"}])
    per_event = spark.createDataFrame([rule_row("r", 1, at(-9), "x")], schema.RULE_SCHEMA)
    none = rulebook.evaluate_windows(logs, per_event)
    assert none.collect() == [] and {"signal_id", "rule_id", "version"} <= set(none.columns)
    for judge in (rulebook.evaluate, rulebook.evaluate_windows):
        assert judge(logs, per_event.limit(0)).collect() == []


def test_windowed_rules_are_checked(spark, make_logs):
    rows = [rule_row("a", 1, at(0), "x", window_s=60), rule_row("b", 1, at(0), "x", window_s=60, count=0),
            rule_row("c", 1, at(0), "x", window_s=0, count=1), rule_row("d", 1, at(0), "x", window_s=60, count=1, key="colour"),
            rule_row("e", 1, None, "x"), rule_row(None, 1, at(0), "x"), rule_row("g", 1, at(0), "x", count=3),
            rule_row("h", 1, at(0), "x", "cpu_percent", ">", 1.0), rule_row("ok", 1, at(0), "x", window_s=60, count=1)]
    table = spark.createDataFrame(rows, schema.RULE_SCHEMA)
    logs = make_logs([{"event_type": "x"}])
    assert {r.rule_id: r.problem for r in rulebook.rejected_rules(table, logs.columns).collect()} == {
        "a": "count not at least 1", "b": "count not at least 1", "c": "window_s not above 0", "d": "unknown key_field",
        "e": "no valid_from", None: "no rule_id", "g": "count or key_field without window_s", "h": "field not in logs"}
    for judge in (rulebook.evaluate, rulebook.evaluate_windows):
        with pytest.raises(ValueError, match="invalid rules"):
            judge(logs, table)


def test_very_many_windowed_rules_are_one_plan(spark, make_logs):
    rows = [rule_row(f"r{i}", 1, at(-9), "x", "latency_ms", ">", float(i), window_s=60, count=2) for i in range(1500)]
    logs = make_logs([{"event_type": "x", "latency_ms": 700.5, "timestamp": at(i)} for i in range(4)])
    found = rulebook.evaluate_windows(logs, spark.createDataFrame(rows, schema.RULE_SCHEMA))
    assert found.count() == 2 * 701


@pytest.mark.parametrize("a, b", [(("a|b", "c"), ("a", "b|c")), ((None, "x"), ("x", None)), (("\\", "|"), ("\\|", "")),
                                  ((None, "a"), ("\\0", "a")), (("", ""), (None, ""))])
def test_ids_do_not_clash(spark, a, b):
    df = spark.createDataFrame([a, b], "p string, q string")
    assert df.select(fields.digest(df.p, df.q).alias("id")).distinct().count() == 2


def test_a_number_beyond_a_long_does_not_stop_detection(make_logs):
    logs = make_logs([{"event_type": "http.request", "latency_ms": m} for m in (1e19, 1e300, 5000.0)])
    assert sorted(r.metadata["latency_ms"] for r in rules.event_signals(logs).collect()) == ["1.0E19", "1.0E300", "5000"]


def test_run_keys_keep_nulls_apart(spark):
    rows = [("x", None), (None, "x"), ("", "x"), ("a\u001fb", "c"), ("a", "b\u001fc"), ("\u001e2", None), (None, None)]
    df = spark.createDataFrame(rows, "p string, q string").withColumn("k", windows.run_key(["p", "q"]))
    assert df.select("k").distinct().count() == len(rows)
    back = df.select("p", "q", *[c.alias(f"{n}_") for n, c in windows.key_parts(df.k, ["p", "q"]).items()]).collect()
    assert all((r.p, r.q) == (r.p_, r.q_) for r in back)
