import random

import pytest
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.functions import classify
from vigilog.operators import anomaly, audit, correlate, incidents as inc, notify, respond
from vigilog.sources import tables
from helpers import at


@pytest.fixture(scope="session")
def make_signals(spark):
    def make(rows):
        out = []
        for i, (kind, service, severity, seconds, *meta) in enumerate(rows):
            out.append((f"s{i:04d}", kind, severity, service, meta[0] if meta else {},
                        at(seconds), f"e{i:04d}", 1))
        return spark.createDataFrame(out, schema.SIGNAL_SCHEMA)

    return make


@pytest.mark.parametrize(
    "error, severity",
    [("Database timeout", "critical"), ("read timeout", "high"), ("connection reset", "high"),
     ("HTTP_ERROR_SPIKE", "medium"), ("BRUTE_FORCE_LOGIN", "low"), ("DB_SLOW_QUERY", "low"),
     ("Timeout Error", "high"), ("", "low")],
)
def test_severity_of_error(spark, error, severity):
    df = spark.createDataFrame([(error,)], "e string")
    assert df.select(classify.error_severity(F.col("e"))).first()[0] == severity


def test_one_incident_per_signal(make_signals):
    found = make_signals([("HTTP_ERROR_SPIKE", "api", "HIGH", 0, {"count": "10"})] * 2)
    rows = inc.create_incidents(found).collect()
    assert len({r.id for r in rows}) == 2
    assert (rows[0].severity, rows[0].status, rows[0].error, rows[0].evidence) == (
        "medium", "open", "HTTP_ERROR_SPIKE", {"count": "10"})
    assert inc.create_incidents(found, "signal").first().severity == "high"


def test_bulk_payload_keeps_order(spark):
    ddl = "payload_id string, signals array<struct<service:string,signal_type:string>>"
    df = spark.createDataFrame([("p", [("a", "X"), ("a", "X"), ("b", "database down")])], ddl)
    rows = inc.incidents_from_payload(df).orderBy("place").collect()
    assert [(r.service, r.severity) for r in rows] == [("a", "low"), ("a", "low"), ("b", "critical")]
    assert len({r.id for r in rows}) == 3


UPDATE = "id string, status string, changed_at timestamp, seq bigint"


def test_last_update_wins(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)] * 2))
    first, second = sorted(r.id for r in opened.collect())
    updates = spark.createDataFrame(
        [(first, "b", at(2), 0), (first, "c", at(2), 1), (first, "a", at(1), 9),
         ("none", "x", at(1), 0)], UPDATE)
    state = {r.id: r.status for r in inc.current_state(opened, updates).collect()}
    assert state == {first: "c", second: "open"}
    assert [r.id for r in inc.missing_updates(opened, updates).collect()] == ["none"]
    assert inc.get_incident(opened, first).count() == 1
    assert inc.get_incident(opened, "none").count() == 0
    assert inc.get_incidents(opened, updates).count() == 1
    last = inc.latest_by_key(updates).collect()
    assert {r.id: r.status for r in last} == {first: "c", "none": "x"}


def test_lifecycle(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)]))
    ident = opened.first().id
    steps = ["in_progress", "in_progress", "resolved", "open"]
    updates = spark.createDataFrame(
        [(ident, s, at(i + 1), 0) for i, s in enumerate(steps)], UPDATE)
    changes = inc.status_changes(opened, updates)
    rows = inc.transitions(changes).orderBy("changed_at").collect()
    assert [r.verdict for r in rows] == ["opened", "valid", "unchanged", "valid", "rejected"]
    notices = notify.lifecycle_notices(changes).orderBy("changed_at").collect()
    assert [r.notice for r in notices] == ["created", "updated", "resolved", "updated"]
    closed = inc.close(opened.select("id"), F.lit(at(9)))
    assert inc.current_state(opened, closed).first().status == "resolved"


@pytest.mark.parametrize("seed", range(2))
def test_strict_lifecycle(spark, make_signals, seed):
    """Forbidden steps are passed over, also for an incident with many updates."""
    rng = random.Random(seed)
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)] * 5))
    ids = sorted(r.id for r in opened.collect())
    calm = {**schema.LIFECYCLE, "resolved": ["open"]}
    steps = [*calm, "odd"]
    feed = [(ids[0] if rng.random() < 0.8 else rng.choice(ids[:4] + ["none"]),
             rng.choice(steps), at(i), 0) for i in range(400)]
    got = {r.id: r.status for r in
           inc.strict_state(opened, spark.createDataFrame(feed, UPDATE), calm).collect()}
    want = dict.fromkeys(ids, "open")
    for ident, status, _, _ in feed:
        if ident in want and status in calm[want[ident]]:
            want[ident] = status
    assert got == want


def test_rollup_and_views(spark, make_signals):
    opened = inc.create_incidents(
        make_signals([("X", "a", "LOW", 0), ("X", "b", "LOW", 0), ("an error", "a", "LOW", 90000)]))
    total = inc.severity_rollup(opened).filter("level = 3").first()
    assert (total.incidents, total.active) == (3, 3)
    assert [r.service for r in inc.top_services(opened, 1).collect()] == ["a"]
    assert inc.daily_trend(opened).count() == 2
    assert inc.active(opened).count() == 3 and inc.historical(opened).count() == 0


def test_sessions_merge_at_exactly_the_gap(make_signals):
    gap = 30_000_000
    found = make_signals([("X", "a", "LOW", s) for s in (0, 30, 60.000001, 200)] + [("X", "b", "HIGH", 1)])
    rows = correlate.incident_sessions(found, gap).orderBy("service", "created_us").collect()
    assert [(r.service, r.occurrence_count, r.priority) for r in rows] == [
        ("a", 2, "LOW"), ("a", 1, "LOW"), ("a", 1, "LOW"), ("b", 1, "HIGH")]
    assert rows[0].context_data == {"first_signal": "s0000", "last_signal": "s0001"}
    links = correlate.session_links(found, gap).collect()
    assert len(links) == 5 and len({r.incident_id for r in links}) == 4


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_session_window(make_signals, seed):
    rng = random.Random(seed)
    found = make_signals(
        [("X", rng.choice("ab"), "LOW", rng.randrange(3000) / 2) for _ in range(300)])
    ours = correlate.incident_sessions(found, 5_000_000).select(
        "service", "created_us", "occurrence_count")
    spark_own = found.groupBy(F.session_window("detected_at", "5 seconds").alias("w"), "service").agg(
        F.count("*").alias("n")).select("service", F.unix_micros("w.start"), "n")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, spark_own.collect()))


def test_correlation_confidence(make_signals):
    found = make_signals([("A", "x", "LOW", 0), ("B", "y", "HIGH", 1), ("B", "y", "HIGH", 1),
                          ("A", "x", "LOW", 100)])
    rows = correlate.correlated_groups(found, 60_000_000).orderBy("window_start_us").collect()
    assert [(r.n_signals, r.confidence, r.cross_service, r.top_severity) for r in rows] == [
        (3, 0.16, True, "HIGH"), (1, 0.04, False, "LOW")]
    per_service = correlate.correlated_groups(found, 60_000_000, by=["service"])
    assert per_service.count() == 3


def test_scored_severity(make_signals):
    found = make_signals([("A", "x", "LOW", i / 10) for i in range(20)] + [("B", "y", "LOW", 0)])
    hour = 3_600_000_000
    rows = inc.score_severity(
        correlate.incident_sessions(found, hour), correlate.correlated_groups(found, hour), hour)
    got = {r.error: (r.score, r.scored_severity) for r in rows.collect()}
    assert got == {"A": (0.568, "HIGH"), "B": (0.188, "LOW")}


def test_zscore_needs_spread(spark):
    rows = [("a", i, 10, e) for i, e in enumerate([1, 1, 1, 1, 9, 2, 0, 9])]
    rates = spark.createDataFrame(rows, "service_name string, window_start_us long, events int, errors int")
    scored = {r.window_start_us: r for r in anomaly.anomalies(rates, history=4, threshold=8).collect()}
    assert scored[0].zscore is None and scored[4].zscore is None
    assert scored[4].is_moving_avg and scored[4].is_threshold and not scored[4].is_zscore
    assert scored[5].moving_avg == 3.0
    assert scored[7].is_threshold


# --- responses --------------------------------------------------------------


def test_playbooks(spark, make_signals, tmp_path):
    opened = inc.create_incidents(make_signals([("DB_SLOW_QUERY", "db", "MEDIUM", 0), ("X", "a", "LOW", 0)]))
    rows = respond.plan_responses(opened, tables.playbooks(spark)).collect()
    assert {(r.error, r.action, r.status) for r in rows} == {
        ("DB_SLOW_QUERY", "restart_database", "success"), ("X", "none", "no_playbook")}
    path = tmp_path / "books.json"
    path.write_text('{\n "X": {"action": "look"},\n "Y": {"action": "wait"}\n}\n')
    books = tables.read_playbooks(spark, str(path))
    assert {tuple(r) for r in books.collect()} == {("X", "look"), ("Y", "wait")}
    assert respond.plan_responses(opened, books).filter("action = 'look'").count() == 1


def test_playbook_join_is_broadcast_by_size(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)]))
    plan = respond.plan_responses(opened, tables.playbooks(spark))
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def attempts(spark, rows):
    return spark.createDataFrame(
        [(f"i{i:03d}", s, "act", "success", at(t)) for i, (s, t) in enumerate(rows)],
        "incident_id string, service string, action string, status string, created_at timestamp")


def decisions(df):
    return [r.decision for r in df.orderBy("incident_id").collect()]


def test_cooldown_edges(spark):
    df = attempts(spark, [("a", 0), ("a", 9.999999), ("a", 19.999999), ("a", 20), ("b", 0)])
    gated = respond.safety_gate(df, 10_000_000, 99, 1)
    assert decisions(gated) == ["allowed", "cooldown", "allowed", "cooldown", "allowed"]


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_equals_lag(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randrange(2000)) for _ in range(200)]
    gap = rng.choice([3, 17])
    gated = respond.safety_gate(attempts(spark, rows), gap * 1_000_000, 999, 1)
    last, want = {}, {}
    for ident, (service, t) in sorted(
        ((f"i{i:03d}", r) for i, r in enumerate(rows)), key=lambda x: (x[1][1], x[0])
    ):
        want[ident] = service in last and t - last[service] < gap
        last[service] = t
    assert {r.incident_id: r.in_cooldown for r in gated.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_after_allowed_equals_loop(spark, seed):
    """A steady run of attempts is let through once per cooldown."""
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), rng.randrange(4000) / 4) for _ in range(500)]
    gap = rng.choice([3, 17, 0.2, 0.5])
    assert cooldowns(spark, rows, gap) == spaced(rows, gap)


def cooldowns(spark, rows, gap):
    gated = respond.safety_gate(attempts(spark, rows), int(gap * 1_000_000), 999, 1, cooldown_after="allowed")
    return {r.incident_id: r.in_cooldown for r in gated.collect()}


def spaced(rows, gap):
    last, want = {}, {}
    for ident, (service, t) in sorted(
        ((f"i{i:03d}", r) for i, r in enumerate(rows)), key=lambda x: (x[1][1], x[0])
    ):
        want[ident] = service in last and round((t - last[service]) * 1e6) < round(gap * 1e6)
        if not want[ident]:
            last[service] = t
    return want


def test_cooldown_below_a_second(spark):
    rows = [("a", 0.9), ("a", 1.1), ("a", 1.4), ("a", 2.3), ("b", 1.1)]
    assert list(cooldowns(spark, rows, 1).values()).count(True) == 2
    assert cooldowns(spark, rows, 0.5) == spaced(rows, 0.5) and cooldowns(spark, rows, 0.2) == spaced(rows, 0.2)
    with pytest.raises(ValueError):
        cooldowns(spark, rows, 0)


@pytest.mark.parametrize("gap", [0.25, 2, 400])
def test_one_key_over_many_tasks(spark, gap):
    rng = random.Random(int(gap))
    # Every quarter second, so that runs begun apart never meet, and a gap with none.
    rows = [("a", t / 4) for t in range(600)] + [("a", 5000 + rng.random()) for _ in range(200)] + [("b", 3), ("b", 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert cooldowns(spark, rows, gap) == spaced([(s, round(t * 1e6) / 1e6) for s, t in rows], gap)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_status_case_does_not_matter(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)]))
    said = opened.selectExpr("id", "'OPEN' AS status", "created_at + interval 1 minute AS changed_at", "0L AS seq")
    changes = inc.status_changes(opened, said)
    assert sorted(r.verdict for r in inc.transitions(changes).collect()) == ["opened", "unchanged"]
    assert notify.lifecycle_notices(changes).count() == 1


def test_retry_limit_and_protection(spark):
    df = attempts(spark, [("a", 0), ("a", 100), ("a", 200), ("a", 201), ("b", 0)])
    protected = spark.createDataFrame([("b",)], "service string")
    gated = respond.safety_gate(df, 1_000_000, 2, 200_000_000, protected)
    assert decisions(gated) == ["allowed", "allowed", "retry_limit", "retry_limit", "protected"]


def test_approvals(spark):
    actions = spark.createDataFrame(
        [("i1", "x", False), ("i2", "x", True), ("i3", "x", True), ("i4", "x", True)],
        "incident_id string, action string, requires_approval boolean")
    said = spark.createDataFrame(
        [("i2", "x", False, at(0)), ("i2", "x", True, at(1)), ("i3", "x", False, at(0))],
        "incident_id string, action string, approved boolean, decided_at timestamp")
    rows = respond.approval_gate(actions, said).orderBy("incident_id").collect()
    assert [r.approval for r in rows] == ["not_needed", "approved", "denied", "awaiting_approval"]


def test_failed_patterns_are_not_repeated(spark):
    past = spark.createDataFrame(
        [("E", "a", "x", "failed", at(5)), ("E", "a", "x", "failed", at(9)), ("E", "b", "x", "success", at(1)),
         ("E", "c", "x", "failed", at(30))],
        "error string, service string, action string, status string, executed_at timestamp")
    new = spark.createDataFrame(
        [("1", "E", "a", "x", at(4)), ("2", "E", "a", "x", at(5)), ("3", "E", "a", "x", at(6)), ("4", "E", "a", "x", at(10)),
         ("5", "E", "b", "x", at(10)), ("6", "E", "c", "x", at(20))],
        "incident_id string, error string, service string, action string, created_at timestamp")
    ids = lambda df: sorted(r.incident_id for r in df.collect())
    # Failures count from the moment after they happened.
    assert ids(respond.suppress_failed(new, past)) == ["1", "2", "5", "6"]
    assert ids(respond.suppress_failed(new, past, 2)) == ["1", "2", "3", "5", "6"]
    assert [(r.incident_id, r.failures) for r in respond.suppressed(new, past, 2).collect()] == [("4", 2)]


def test_best_playbook(spark, make_signals):
    books = spark.createDataFrame(
        [("p1", "X", "LOW", "HIGH", 1, "a"), ("p2", "X", "HIGH", "CRITICAL", 2, "b"),
         ("p3", "X", "LOW", "LOW", 1, "c")],
        "playbook_id string, trigger_signal string, min_severity string, max_severity string, "
        "priority int, action string")
    past = spark.createDataFrame([("X", "c", "success")], "error string, action string, status string")
    opened = inc.create_incidents(
        make_signals([("X", "s", v, 0) for v in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), "signal")
    rows = respond.match_playbooks(opened, respond.select_playbooks(books, past)).collect()
    assert {r.severity: r.playbook_id for r in rows} == {
        "low": "p3", "medium": "p1", "high": "p2", "critical": "p2"}


def test_action_plan(spark, make_signals):
    books = spark.createDataFrame(
        [("p", "n", "X", True, [(2, "NOTIFY_ONLY", "ops", "n", 0), (1, "RUN_SCRIPT", None, "r", 1)])],
        schema.STEP_PLAYBOOK_SCHEMA)
    opened = inc.create_incidents(make_signals([("X", "svc", "LOW", 0), ("Y", "svc", "LOW", 0)]))
    rows = respond.action_plan(opened, books).orderBy("step_order").collect()
    assert [(r.action_type, r.target_service) for r in rows] == [("RUN_SCRIPT", "svc"), ("NOTIFY_ONLY", "ops")]


# --- notifications and audit ----------------------------------------------------


INPUT = "incident_id string, service string, severity string, event_type string, timestamp string, message string"


def test_routes(spark):
    rows = [("1", "s", "high", "E", "t", None), ("2", "s", "Critical", "E", "t", "m"),
            ("3", "s", "medium", "E", "t", None), ("4", None, "HIGH", "E", None, None)]
    df = spark.createDataFrame(rows, INPUT)
    assert {r.incident_id: r.route for r in notify.route(df).collect()} == {
        "1": "alert", "2": "alert", "3": "log"}
    assert notify.sent_count(df).first()[0] == 3
    assert [r.missing for r in notify.rejected(df).collect()] == ["service,timestamp"]


@pytest.mark.parametrize(
    "channels, expected",
    [
        (notify.Channels(), {"webhook": "skipped"}),
        (notify.Channels("http://x"), {"webhook": "planned"}),
        (notify.Channels("", True, "u", "p", "to"), {"webhook": "skipped", "email": "planned"}),
        (notify.Channels("http://x", True, "u", "", "to"), {"webhook": "planned", "email": "skipped"}),
    ],
)
def test_channels(spark, channels, expected):
    df = spark.createDataFrame([("1", "s", "high", "E", "t", None), ("2", "s", "low", "E", "t", None)], INPUT)
    rows = notify.fan_out(df, channels).collect()
    assert {r.channel: r.delivery_state for r in rows} == expected


def test_message_texts(spark):
    df = spark.createDataFrame([("1", "svc", "HIGH", "E", "T", "text")], INPUT)
    channels = notify.Channels("http://x", True, "u", "p", "to")
    rows = {r.channel: r for r in notify.fan_out(df, channels).collect()}
    assert rows["email"].subject == "[INCIDENT] HIGH - svc"
    assert rows["email"].body.split("\n") == [
        "", "Incident Alert", "", "Service: svc", "Severity: HIGH", "Event: E", "Time: T", "",
        "Message:", "text", ""]
    assert rows["webhook"].body.split("\n")[3:] == [
        "Service: svc", "Severity: HIGH", "Type: E", "Time: T", ""]


def test_audit(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)]))
    plan = respond.plan_responses(opened, tables.playbooks(spark))
    trail = audit.audit_trail(opened, plan)
    rows = audit.report(trail, opened.first().id).collect()
    assert [(r.component_name, r.action_performed, r.outcome) for r in rows] == [
        ("incidents", "created", "low"), ("responses", "none", "no_playbook")]
    assert len({r.audit_id for r in rows}) == 2


def test_latency_below_a_second(make_signals):
    found = make_signals([("X", "a", "LOW", 0)] * 3)
    row = audit.detection_latency(found, F.unix_micros("detected_at") + 900_999).first()
    assert (row.max_s, row.p50) == (0.9, 0.9)


def test_executed_actions_enter_the_trail_when_they_ran(spark, make_signals):
    opened = inc.create_incidents(make_signals([("X", "a", "LOW", 0)]))
    ran = respond.plan_responses(opened, tables.playbooks(spark)).withColumn("executed_at", F.lit(at(77)))
    rows = {r.component_name: r.timestamp for r in audit.audit_trail(opened, ran).collect()}
    assert (rows["responses"] - rows["incidents"]).total_seconds() == 77


def test_latency_quantiles(make_signals):
    found = make_signals([("X", "a", "LOW", 0)] * 101)
    delay = F.substring("signal_id", 2, 4).cast("bigint") * 1_000_000
    row = audit.detection_latency(found, F.unix_micros("detected_at") + delay).first()
    assert (row.signals, row.max_s, row.p50, row.p95, row.p99) == (101, 100, 50.0, 95.0, 99.0)


