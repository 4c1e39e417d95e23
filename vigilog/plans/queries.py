"""Registered queries: every operator over the whole ``events`` table.

The table's events are days apart per user, so windows here are wider than the
library's defaults. Times come out as UTC microseconds.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators import (
    anomaly, audit, correlate, formats, incidents as inc, lifecycle, notify, parse, process, respond, rulebook,
    rules, search, sketch, windows,
)
from vigilog.session import cut, scratch, spread
from vigilog.sources import event_table, tables
from vigilog.sources.text_index import TextIndex

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
MINUTE_US = 60_000_000

SPIKE = dict(count=5, window_s=6 * 3600)
BRUTE = dict(count=3, window_s=24 * 3600)

ALL_BOOKS = {
    "DB_SLOW_QUERY": "restart_database",
    "HTTP_ERROR_SPIKE": "restart_http_service",
    "BRUTE_FORCE_LOGIN": "lock_accounts",
    "DEPLOYMENT_FAILURE": "rollback_deployment",
}
CHANNELS = notify.Channels(
    webhook_url="https://hooks.example/alerts", email_enabled=True,
    smtp_user="alerts", smtp_password="set", email_to="oncall@example",
)


def us(column: str, name: str = "us") -> Column:
    return fields.micros(F.col(column)).alias(name)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table.read_logs(spark, sf_dir)


def window_rules() -> list[rules.WindowRule]:
    return [rules.error_spike_rule(**SPIKE), rules.brute_force_rule(**BRUTE)]


def signals(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """All signals; ``stored`` for queries that read them more than once."""
    found = rules.detect(logs(spark, sf_dir), windowed=window_rules())
    return cut(found) if stored else found


def incidents(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return inc.create_incidents(signals(spark, sf_dir, stored))


def signal_incidents(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return inc.create_incidents(signals(spark, sf_dir, stored), severity_source="signal")


def updates(opened: DataFrame) -> DataFrame:
    """A made-up feed of status updates about the given incidents."""
    latency = F.col("evidence")["latency_ms"].cast("double")

    def step(when: Column, status: str, minutes: int, seq: int, known: bool = True) -> Column:
        target = F.col("id") if known else fields.digest(F.lit("ghost"), F.col("id"))
        return F.when(
            when,
            F.struct(
                target.alias("id"),
                F.lit(status).alias("status"),
                F.timestamp_micros(us("created_at") + minutes * MINUTE_US).alias("changed_at"),
                F.lit(seq).cast("bigint").alias("seq"),
            ),
        )

    high = F.col("signal_severity") == "HIGH"
    steps = [
        step(high, "in_progress", 10, 0),
        step(high, "in_progress", 15, 1),
        step(F.col("error") == "DEPLOYMENT_FAILURE", "escalated", 25, 2),
        step(latency > 3000, "resolved", 30, 0),
        step(latency > 4000, "in_progress", 30, 1),
        step(F.col("error") == "HTTP_ERROR_SPIKE", "resolved", 5, 0, known=False),
    ]
    return opened.select(F.explode(F.array_compact(F.array(*steps))).alias("u")).select("u.*")


def planned(opened: DataFrame) -> DataFrame:
    books = tables.playbooks(opened.sparkSession, ALL_BOOKS)
    return respond.plan_responses(opened, books).filter("status <> 'no_playbook'")


def executed(opened: DataFrame) -> DataFrame:
    """Planned responses with a made-up outcome taken from the evidence."""
    latency = F.col("evidence")["latency_ms"].cast("double")
    failed = (latency > 3500) | (
        (F.col("error") == "DEPLOYMENT_FAILURE") & F.col("evidence")["reason"].isNotNull()
    )
    return (
        planned(opened)
        .withColumn("status", F.when(F.coalesce(failed, F.lit(False)), "failed")
                    .otherwise("success"))
        .withColumn("executed_at", F.timestamp_micros(us("created_at") + MINUTE_US))
    )


# --- processing ---------------------------------------------------------------


def processed_logs(spark, sf_dir):
    return process.process_logs(logs(spark, sf_dir)).select(
        "event_id", "service_name", us("timestamp"), "normalized_type", "severity",
        F.col("features.latency_bucket").alias("latency_bucket"), "region", "cluster",
    )


def severity_counts(spark, sf_dir):
    return process.process_logs(logs(spark, sf_dir)).groupBy("normalized_type", "severity").agg(
        F.count("*").alias("events"))


def latency_buckets(spark, sf_dir):
    return (
        process.process_logs(logs(spark, sf_dir))
        .groupBy(F.col("features.service").alias("service"),
                 F.col("features.latency_bucket").alias("latency_bucket"))
        .agg(F.count("*").alias("events"))
    )


def _spread_logs(spark, sf_dir):
    """Log rows for the parsers, whose work per row is worth all cores."""
    return event_table.as_logs(spread(event_table.read_events(spark, sf_dir)))


def _json_lines(spark, sf_dir):
    return event_table.as_json_lines(_spread_logs(spark, sf_dir))


def parsed_json_lines(spark, sf_dir):
    return process.process_lines(_json_lines(spark, sf_dir).select("value")).select(
        "event_id", "service_name", "log_level", us("timestamp"), "normalized_type", "severity",
        F.col("status").cast("int").alias("status"), "latency_ms", "client_ip",
    )


def dead_letters(spark, sf_dir):
    parsed = parse.parse_json_lines(_json_lines(spark, sf_dir))
    return parse.dead_letters(parsed).groupBy("reason").agg(
        F.count("*").alias("lines"))


def processing_status(spark, sf_dir):
    parsed = parse.parse_json_lines(_json_lines(spark, sf_dir))
    return process.classify_status(parsed).groupBy(F.col("_status").alias("status")).agg(
        F.count("*").alias("lines"))


def regex_parsed_lines(spark, sf_dir):
    lines = event_table.as_text_lines(_spread_logs(spark, sf_dir))
    return parse.parse_text_lines(lines).filter("pattern is not null").select(
        "pattern", "service_name", "event_type", "log_level", us("timestamp"),
        F.col("status").cast("int").alias("status"), "client_ip", "path", "version",
        F.round("latency_ms", 2).alias("latency_ms"),
    )


def regex_unmatched_lines(spark, sf_dir):
    lines = event_table.as_text_lines(_spread_logs(spark, sf_dir))
    return parse.parse_text_lines(lines).filter("pattern is null").groupBy("value").agg(
        F.count("*").alias("lines"))


def format_table(spark, others: int = 190):
    """The formats of ``event_table.as_text_lines``, special ones before general ones,
    among ``others`` of services that these logs do not have."""
    at, rest = r"(\d{4}-\d\d-\d\dT\S+)", r"\s+([A-Z]+)\s+(\S+)\s+"
    said = {"timestamp": 1, "log_level": 2, "service_name": 3, "message": 4}
    asked = {"client_ip": 1, "timestamp": 2, "message": 3, "path": 4, "status": 5, "latency_ms": 6}
    http = {"service_name": "api-gateway", "event_type": "http.request"}

    def access(path, status):
        return rf'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+ ({path})[^"]*)" ({status}) ([\d.]+)$'

    rows = [
        ("failed_login", 1, rf"^{at}{rest}\[auth\.login_failed\] (.*?) client_ip=\S+$", said,
         {"event_type": "auth.login_failed"}),
        ("deployment", 1, rf"^{at}{rest}\[deployment\.failed\] (.*)$", said, {"event_type": "deployment.failed"}),
        ("server_error", 2, access(r"\S+", r"5\d\d"), asked, {**http, "log_level": "ERROR"}),
        ("first_path", 3, access("/api/v1/r0", r"\d{3}"), asked, http),
        ("access_line", 9, access(r"\S+", r"\d{3}"), asked, http),
        ("service_line", 9, rf"^{at}{rest}\[([^\]]+)\]\s+(.*)$", {**said, "event_type": 4, "message": 5}, {}),
        *((f"other_{i}", 1, rf"^{at}{rest}\[svc{i}\.(?:start|stop)\]\s+unit-{i}: (.*)$", said, {})
          for i in range(others)),
    ]
    return spark.createDataFrame(rows, formats.FORMAT_DDL)


def lines_by_format_table(spark, sf_dir):
    lines = event_table.as_text_lines(_spread_logs(spark, sf_dir))
    return formats.parse_by_formats(lines, format_table(spark)).select(
        "pattern", "service_name", "event_type", "log_level", us("timestamp"), "message",
        F.col("status").cast("int").alias("status"), "client_ip", "path", "version",
        F.round("latency_ms", 2).alias("latency_ms"))


def search_logs(spark, sf_dir):
    found = search.search_logs(
        logs(spark, sf_dir), service="api-gateway", level="ERROR",
        since="2024-01-05T00:00:00Z", until="2024-01-20T00:00:00Z", contains="K=2")
    return found.select("event_id", us("timestamp"), "event_type", "message")


def search_by_index(spark, sf_dir):
    """A text that few files hold, found by the index of a table in day folders."""
    root = scratch(spark, "indexed")
    tables.write_by_day(logs(spark, sf_dir), f"{root}/logs")
    index = TextIndex(spark, f"{root}/logs", f"{root}/index", buckets=16)
    index.update()
    return index.search("DEPLOYMENT.FAILED k=5", level="ERROR").select(
        "event_id", us("timestamp"), "service_name", "message")


def replayed_signals(spark, sf_dir):
    return search.replay(
        logs(spark, sf_dir), "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z",
        rules.event_signals,
    ).select("signal_id", "signal_type", us("detected_at"))


# --- detection ----------------------------------------------------------------


def _event_rule(spark, sf_dir, rule, **evidence):
    return rules.event_signals(logs(spark, sf_dir), [rule]).select(
        "signal_id", "severity", "service", us("detected_at"),
        *[F.col("metadata")[k].cast(t).alias(k) for k, t in evidence.items()],
    )


def signals_high_latency(spark, sf_dir):
    return _event_rule(spark, sf_dir, rules.latency_rule(), latency_ms="double")


def signals_deployment_failure(spark, sf_dir):
    return _event_rule(
        spark, sf_dir, rules.deployment_failure_rule(), version="string", reason="string")


def signals_db_slow_query(spark, sf_dir):
    return _event_rule(spark, sf_dir, rules.slow_query_rule(), latency_ms="double")


SIGNAL_OUT = ["signal_id", "signal_type", "severity", "service", "event_id", "rule_order"]


def signals_all(spark, sf_dir):
    return signals(spark, sf_dir).select(*SIGNAL_OUT, us("detected_at"))


def signal_counts(spark, sf_dir):
    return rules.event_signals(logs(spark, sf_dir)).groupBy("signal_type", "severity").agg(
        F.count("*").alias("signals"))


def signals_bruteforce(spark, sf_dir):
    return rules.window_signals(logs(spark, sf_dir), rules.brute_force_rule(**BRUTE)).select(
        "event_id", "service", us("detected_at"), F.col("metadata")["ip"].alias("ip"))


def signals_error_spike(spark, sf_dir):
    return rules.window_signals(logs(spark, sf_dir), rules.error_spike_rule(**SPIKE)).select(
        "event_id", "service", us("detected_at"),
        F.col("metadata")["count"].cast("bigint").alias("error_count"))


def signals_error_spike_by_host(spark, sf_dir):
    rule = rules.error_spike_rule(3, 6 * 3600, key=("host",))
    return rules.window_signals(logs(spark, sf_dir), rule).select(
        "event_id", "service", us("detected_at"))


def signals_per_event(spark, sf_dir):
    rows = rules.signals_per_event(logs(spark, sf_dir), signals(spark, sf_dir))
    return rows.select(
        "event_id", F.size("signals").cast("bigint").alias("n_signals"),
        F.concat_ws(",", "signals.signal_type").alias("signal_types"))


def sliding_failure_count(spark, sf_dir):
    failed = logs(spark, sf_dir).filter("event_type = 'auth.login_failed'").select(
        "client_ip", "event_id", us("timestamp"))
    return windows.sliding_count(failed, ["client_ip"], "us", DAY_US)


def rule_table(spark):
    def at(day):
        return datetime(2024, 1, day, tzinfo=timezone.utc)

    rows = [
        ("latency", 1, at(1), "http.request", "latency_ms", ">", 2000.0, "HIGH_LATENCY",
         "MEDIUM", None, None, None),
        ("latency", 2, at(11), "http.request", "latency_ms", ">=", 3000.0, "HIGH_LATENCY",
         "HIGH", None, None, None),
        ("latency", 3, at(21), "http.request", "latency_ms", ">", 4000.0, "HIGH_LATENCY",
         "CRITICAL", None, None, None),
        ("deploy", 1, at(6), "deployment.failed", None, None, None, "DEPLOYMENT_FAILURE",
         "HIGH", None, None, None),
        ("missing", 1, at(1), "http.request", "status", "=", 404.0, "HTTP_NOT_FOUND", "LOW",
         None, None, None),
        ("spike", 1, at(1), "http.request", "status", ">=", 500.0, "HTTP_ERROR_SPIKE", "HIGH",
         6 * 3600, 5, None),
        ("spike", 2, at(16), "http.request", "status", ">=", 400.0, "HTTP_ERROR_SPIKE", "HIGH",
         3 * 3600, 6, None),
        ("logins", 1, at(1), "auth.login_failed", None, None, None, "BRUTE_FORCE_LOGIN", "HIGH",
         24 * 3600, 3, "client_ip"),
        # A rule that changes its kind, and one about a text.
        ("deploys", 1, at(1), "deployment.failed", None, None, None, "DEPLOYMENT_SEEN", "LOW",
         None, None, None),
        ("deploys", 2, at(13), "deployment.failed", None, None, None, "DEPLOYMENT_STORM", "HIGH",
         12 * 3600, 2, None),
        ("crash", 1, at(1), "deployment.failed", "reason", "=", None, "CONTAINER_CRASH", "HIGH",
         None, None, None, "container_crash"),
    ]
    return spark.createDataFrame([(*r, None)[:13] for r in rows], schema.RULE_SCHEMA)


def rules_as_of(spark, sf_dir):
    return rulebook.evaluate(logs(spark, sf_dir), rule_table(spark)).select(
        "signal_id", "rule_id", "version", "signal_type", "severity", us("detected_at"))


def rules_as_of_windows(spark, sf_dir):
    return rulebook.evaluate_windows(logs(spark, sf_dir), rule_table(spark)).select(
        "rule_id", "version", "signal_type", "event_id", us("detected_at"))


def ids_of_texts(spark, sf_dir):
    """Ids of pairs that a plain joining of texts would mix up: separators,
    backslashes and nulls in either part."""
    rows, kind = logs(spark, sf_dir), F.col("event_type")
    k = F.concat(F.lit("k"), F.regexp_extract("message", "[0-9]+$", 0))
    none = F.lit(None).cast("string")
    pairs = [
        (F.replace("message", F.lit(" "), F.lit("|")), F.replace("path", F.lit("/"), F.lit("\\"))),
        (none, F.col("message")), (F.col("message"), none),
        (F.concat(kind, F.lit("|")), k), (kind, F.concat(F.lit("|"), k)),
        (F.concat(kind, F.lit("\\")), k), (kind, F.concat(F.lit("\\"), k)),
    ]
    ids = F.array(*[fields.digest(a, b) for a, b in pairs])
    return rows.select(F.explode(ids).alias("id")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


# --- correlation and anomalies --------------------------------------------------


def correlated_groups(spark, sf_dir):
    return correlate.correlated_groups(signals(spark, sf_dir), HOUR_US).select(
        "group_id", "window_start_us", "n_signals",
        F.col("n_services").cast("bigint").alias("n_services"),
        F.col("n_types").cast("bigint").alias("n_types"),
        F.concat_ws(",", "services").alias("services"), "top_severity", "confidence",
        "cross_service")


def correlated_traces(spark, sf_dir):
    """Groups within one trace, where the trace is what services share."""
    found = rules.detect(
        logs(spark, sf_dir), windowed=window_rules(), context=("trace_id",))
    return correlate.correlated_groups(found, DAY_US, by=["trace_id"]).select(
        "group_id", "window_start_us", "trace_id", "n_signals",
        F.concat_ws(",", "services").alias("services"), "confidence")


def correlation_links(spark, sf_dir):
    return correlate.correlation_links(signals(spark, sf_dir), HOUR_US).select(
        "group_id", "signal_id")


def interval_links(spark, sf_dir):
    """Signals up to 20 minutes from each other, over the ends of hours too."""
    return correlate.interval_links(signals(spark, sf_dir, stored=True), 20 * MINUTE_US).select(
        "group_id", "signal_id", "us", "group_start_us", "n_links")


def interval_groups(spark, sf_dir):
    return correlate.interval_groups(signals(spark, sf_dir, stored=True), 20 * MINUTE_US).select(
        "group_id", "group_start_us", "group_end_us", "n_signals", "n_links",
        F.concat_ws(",", "services").alias("services"), "top_severity", "confidence")


def interval_traces(spark, sf_dir):
    """Groups within a trace."""
    found = cut(rules.detect(logs(spark, sf_dir), windowed=window_rules(), context=("trace_id",)))
    return correlate.interval_groups(found, 7 * DAY_US, by=["trace_id"]).select(
        "group_id", "group_start_us", "group_end_us", "trace_id", "n_signals", "n_links",
        F.concat_ws(",", "services").alias("services"), "confidence")


def signals_after_deployments(spark, sf_dir):
    """Each failed deployment with the other signals of the two hours after it."""
    found = signals(spark, sf_dir, stored=True).withColumn("us", us("detected_at"))
    failed = found.filter("signal_type = 'DEPLOYMENT_FAILURE'").select("signal_id", "us")
    other = found.filter("signal_type <> 'DEPLOYMENT_FAILURE'").select("signal_id", "signal_type", "us")
    pairs = correlate.band_join(failed, other, [], "us", "us", 0, 2 * HOUR_US, split=50)
    return pairs.select(
        F.col("l.signal_id").alias("deployment_id"), F.col("r.signal_id").alias("signal_id"),
        F.col("r.signal_type").alias("signal_type"), (F.col("r.us") - F.col("l.us")).alias("after_us"))


def error_rate_by_window(spark, sf_dir):
    return anomaly.error_rate(logs(spark, sf_dir), HOUR_US)


def zscore_anomalies(spark, sf_dir):
    rates = anomaly.error_rate(logs(spark, sf_dir), HOUR_US)
    scored = anomaly.anomalies(rates, history=24, threshold=3)
    return anomaly.flagged(scored).select(
        "service_name", "window_start_us", "errors", "moving_avg", "moving_std", "zscore",
        "is_zscore", "is_moving_avg", "is_threshold")


ANOMALY_COLUMNS = [
    "service_name", "window_start_us", "errors", "moving_avg", "moving_std", "zscore", "is_zscore", "is_moving_avg",
    "is_threshold"]


def zscore_anomalies_dense(spark, sf_dir):
    """With the hours in which a service said nothing."""
    rates = anomaly.error_rate(logs(spark, sf_dir), HOUR_US)
    scored = anomaly.dense_anomalies(rates, HOUR_US, history=24, threshold=3)
    return anomaly.flagged(scored).select(*ANOMALY_COLUMNS)


def silence_anomalies(spark, sf_dir):
    """Hours with far more or fewer events than the day before, silent ones too."""
    rates = anomaly.error_rate(logs(spark, sf_dir), HOUR_US)
    scored = anomaly.dense_anomalies(rates, HOUR_US, history=24, value="events")
    return anomaly.flagged(scored).select("service_name", "window_start_us", "events", "moving_avg", "zscore")


def incident_sessions(spark, sf_dir):
    return correlate.incident_sessions(signals(spark, sf_dir), HOUR_US).select(
        "incident_id", "service", "error", "status", "priority", "occurrence_count",
        "created_us", "updated_us",
        F.col("context_data")["first_signal"].alias("first_signal"),
        F.col("context_data")["last_signal"].alias("last_signal"))


def session_links(spark, sf_dir):
    return correlate.session_links(signals(spark, sf_dir, stored=True), HOUR_US)


def incident_severity_scored(spark, sf_dir):
    found = signals(spark, sf_dir, stored=True)
    groups = correlate.correlated_groups(found, HOUR_US)
    sessions = correlate.incident_sessions(found, HOUR_US)
    return inc.score_severity(sessions, groups, HOUR_US, full_frequency=4).select(
        "incident_id", "service", "error", "occurrence_count", "score", "scored_severity")


# --- incidents ------------------------------------------------------------------


def created_incidents(spark, sf_dir):
    return incidents(spark, sf_dir).select(
        "id", "service", "error", "severity", "status", us("created_at", "created_us"),
        "signal_id", "signal_severity")


def incidents_by_signal_severity(spark, sf_dir):
    return signal_incidents(spark, sf_dir).groupBy("severity", "error").agg(
        F.count("*").alias("incidents"))


def incidents_from_payload(spark, sf_dir):
    found = signals(spark, sf_dir)
    payloads = rules.signals_per_event(logs(spark, sf_dir), found).join(
        logs(spark, sf_dir).select("event_id", F.col("service_name").alias("service")), "event_id")
    body = F.transform(
        "signals", lambda s: F.struct(F.col("service"), s["signal_type"].alias("signal_type")))
    return inc.incidents_from_payload(
        payloads.select(F.col("event_id").alias("payload_id"), body.alias("signals"))
    ).select("id", "service", "error", "severity", "status", "payload_id",
             F.col("place").cast("bigint").alias("place"))


def incidents_latest_after_updates(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.current_state(opened, updates(opened)).select(
        "id", "service", "error", "severity", "status", us("changed_at", "changed_us"))


def incidents_missing_updates(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.missing_updates(opened, updates(opened)).select(
        "id", "status", us("changed_at", "changed_us"))


def incidents_found_by_id(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.get_incidents(opened, updates(opened).filter("status = 'resolved'")).select(
        "id", "error")


def incident_status_history(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    changes = inc.status_changes(opened, updates(opened))
    return inc.latest_by_key(changes).select("id", "status", us("changed_at", "changed_us"))


def lifecycle_transitions(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.transitions(inc.status_changes(opened, updates(opened))).select(
        "id", "previous", "status", us("changed_at", "changed_us"), "seq", "verdict")


def incidents_strict_state(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.strict_state(opened, updates(opened)).select("id", "error", "status")


#: Seconds that a state may last.
DEADLINES = {"open": 20 * 60, "in_progress": 12 * 60}


def step_columns(steps: DataFrame) -> DataFrame:
    return steps.select("id", "previous", "status", us("changed_at", "changed_us"), "seq", "verdict", "state", "notice")


def incidents_judged(spark, sf_dir):
    """Updates in order, overdue incidents escalated."""
    opened = incidents(spark, sf_dir, stored=True)
    return step_columns(lifecycle.judged(opened, updates(opened), deadlines_s=DEADLINES))


def incidents_overdue(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    steps = lifecycle.judged(opened, updates(opened), deadlines_s=DEADLINES)
    return lifecycle.escalated_when_overdue(steps).select("id", "status", us("changed_at", "changed_us"), "seq")


def lifecycle_notices(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return notify.lifecycle_notices(inc.status_changes(opened, updates(opened))).select(
        "id", "previous", "status", us("changed_at", "changed_us"), "notice")


def incident_rollup(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    state = inc.current_state(opened, updates(opened))
    return inc.severity_rollup(state).withColumn("level", F.col("level").cast("bigint"))


def incidents_active(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.active(inc.current_state(opened, updates(opened))).select("id", "status")


def incidents_historical(spark, sf_dir):
    opened = incidents(spark, sf_dir, stored=True)
    return inc.historical(inc.current_state(opened, updates(opened))).select("id", "status")


def incident_trend_daily(spark, sf_dir):
    return inc.daily_trend(incidents(spark, sf_dir))


def top_services(spark, sf_dir):
    return inc.top_services(incidents(spark, sf_dir), 3)


# --- responses ------------------------------------------------------------------


def responses(spark, sf_dir):
    return respond.plan_responses(incidents(spark, sf_dir), tables.playbooks(spark)).select(
        "incident_id", "action", "status")


def playbook_coverage(spark, sf_dir):
    return respond.playbook_coverage(signals(spark, sf_dir), tables.playbooks(spark))


def _step_books(spark):
    rows = [
        ("pb-db", "database", "DB_SLOW_QUERY", False,
         [(1, "RUN_SCRIPT", None, "kill_long_queries", 2),
          (2, "RESTART_SERVICE", "db-monitor", "restart", 1)]),
        ("pb-deploy", "deployment", "DEPLOYMENT_FAILURE", True,
         [(1, "ROLLBACK_DEPLOYMENT", None, "rollback", 1), (2, "NOTIFY_ONLY", None, "notify", 0)]),
        ("pb-login", "logins", "BRUTE_FORCE_LOGIN", True,
         [(1, "BLOCK_IP", "api-gateway", "block", 3)]),
    ]
    return spark.createDataFrame(rows, schema.STEP_PLAYBOOK_SCHEMA)


def action_plan_steps(spark, sf_dir):
    return respond.action_plan(incidents(spark, sf_dir), _step_books(spark))


def safety_gate(spark, sf_dir):
    attempts = planned(signal_incidents(spark, sf_dir, stored=True))
    protected = spark.createDataFrame([("auth-service",)], "service string")
    return respond.safety_gate(attempts, 2 * HOUR_US, 3, 12 * HOUR_US, protected).select(
        "incident_id", "service", "action", "us", "attempts", "in_cooldown", "decision")


def safety_gate_after_allowed(spark, sf_dir):
    attempts = planned(signal_incidents(spark, sf_dir, stored=True))
    return respond.safety_gate(
        attempts, 2 * HOUR_US, 3, 12 * HOUR_US, cooldown_after="allowed"
    ).select("incident_id", "service", "action", "us", "in_cooldown", "decision")


#: Cooldown, limits and window of attempts.
GATES = dict(cooldown_us=2 * HOUR_US, retry_limit=3, retry_window_us=12 * HOUR_US, failure_limit=5)


def protected_services(spark):
    return spark.createDataFrame([("auth-service",)], "service string")


def responses_gated(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    return respond.gated(planned(opened), executed(opened), protected=protected_services(spark), **GATES).select(
        "incident_id", "service", "action", "error", "us", "attempts", "in_cooldown", "suppressed", "decision")


def approval_gate(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    actions = respond.action_plan(opened, _step_books(spark)).select(
        "incident_id", F.col("command").alias("action"), "requires_approval")
    return respond.approval_gate(actions, _approvals(opened))


def _approvals(opened):
    """Made-up decisions about risky actions, some of them revised."""
    reason = F.col("evidence")["reason"]
    deploy = F.col("error") == "DEPLOYMENT_FAILURE"

    def decision(when, action, approved, minutes):
        return F.when(when, F.struct(
            F.col("id").alias("incident_id"), F.lit(action).alias("action"),
            F.lit(approved).alias("approved"),
            F.timestamp_micros(us("created_at") + minutes * MINUTE_US).alias("decided_at")))

    decisions = [
        decision(deploy, "rollback", True, 3),
        decision(deploy & reason.isNotNull(), "rollback", False, 4),
        decision(F.col("error") == "BRUTE_FORCE_LOGIN", "block", False, 2),
    ]
    return opened.select(F.explode(F.array_compact(F.array(*decisions))).alias("d")).select("d.*")


def failure_suppression(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    return respond.suppress_failed(planned(opened), executed(opened), 5).select(
        "incident_id", "error", "service", "action", "status")


def failure_suppressed(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    return respond.suppressed(planned(opened), executed(opened), 5).groupBy(
        "error", "service", "action", "failures").agg(F.count("*").alias("held_back"))


def _books(spark):
    rows = [
        ("b-1", "DB_SLOW_QUERY", "LOW", "CRITICAL", 1, "restart_database"),
        ("b-2", "DB_SLOW_QUERY", "MEDIUM", "MEDIUM", 1, "scale_database"),
        ("b-3", "DEPLOYMENT_FAILURE", "LOW", "MEDIUM", 9, "notify"),
        ("b-4", "DEPLOYMENT_FAILURE", "HIGH", "CRITICAL", 2, "rollback_deployment"),
        ("b-5", "DEPLOYMENT_FAILURE", "MEDIUM", "CRITICAL", 2, "restart_http_service"),
        ("b-6", "BRUTE_FORCE_LOGIN", "HIGH", "HIGH", 1, "lock_accounts"),
    ]
    return spark.createDataFrame(
        rows, "playbook_id string, trigger_signal string, min_severity string, "
              "max_severity string, priority int, action string")


def playbook_best_match(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    best = respond.select_playbooks(_books(spark), executed(opened))
    return respond.match_playbooks(opened, best)


def playbook_choice_as_of(spark, sf_dir):
    """Two actions that are tried in turn; an outcome counts once it is known."""
    opened = signal_incidents(spark, sf_dir, stored=True)
    history = executed(opened)
    other = F.when(F.col("action") == "rollback_deployment", "restart_http_service").when(
        F.col("action") == "restart_database", "scale_database").otherwise(F.col("action"))
    odd = F.pmod(F.floor(us("created_at") / MINUTE_US), F.lit(2)) == 1
    history = history.withColumn("action", F.when(odd, other).otherwise(F.col("action")))
    return respond.choose_playbooks_as_of(opened, _books(spark), history)


def escalations(spark, sf_dir):
    return respond.escalations(executed(signal_incidents(spark, sf_dir))).select(
        "id", "status", us("changed_at", "changed_us"))


def execution_results(spark, sf_dir):
    return respond.execution_results(
        executed(signal_incidents(spark, sf_dir))
    ).select("execution_id", us("timestamp"), "status", "message")


# --- notifications, audit, metrics ------------------------------------------------


def notifications_routed(spark, sf_dir):
    return notify.route(notify.from_incidents(signal_incidents(spark, sf_dir))).select(
        "incident_id", "service", "severity", "event_type", "timestamp", "route")


def notification_messages(spark, sf_dir):
    return notify.fan_out(
        notify.from_incidents(signal_incidents(spark, sf_dir)), CHANNELS
    ).select("incident_id", "channel", "delivery_state", "subject", "body")


def _notices_about_logs(spark, sf_dir):
    """Notification inputs straight from logs; few carry a reason."""
    return process.process_logs(logs(spark, sf_dir)).select(
        F.col("event_id").alias("incident_id"), F.col("service_name").alias("service"),
        "severity", F.coalesce("reason", "path").alias("event_type"),
        fields.iso_millis(F.col("timestamp")).alias("timestamp"), "message")


def notifications_rejected(spark, sf_dir):
    return notify.rejected(_notices_about_logs(spark, sf_dir)).select("incident_id", "missing")


def notifications_count(spark, sf_dir):
    return notify.sent_count(_notices_about_logs(spark, sf_dir))


def _trail(spark, sf_dir):
    opened = signal_incidents(spark, sf_dir, stored=True)
    notices = notify.lifecycle_notices(inc.status_changes(opened, updates(opened)))
    return audit.audit_trail(opened, executed(opened), _approvals(opened), notices)


def audit_trail(spark, sf_dir):
    return _trail(spark, sf_dir).select(
        "audit_id", "incident_id", us("timestamp"), "component_name", "action_performed",
        "outcome")


def audit_report(spark, sf_dir):
    return audit.report(_trail(spark, sf_dir)).select(
        "audit_id", "incident_id", us("timestamp"), "component_name", "action_performed",
        "outcome")


def detection_latency_quantiles(spark, sf_dir):
    """As if signals left the pipeline at the end of their event's hour."""
    found = rules.event_signals(logs(spark, sf_dir))
    emitted = fields.floor_to(fields.micros(F.col("detected_at")), HOUR_US) + HOUR_US
    out = audit.detection_latency(found, emitted)
    return out.select(
        "signal_type", "signals", *[F.round(c, 6).alias(c) for c in ("max_s", "p50", "p95", "p99")])


def latency_us():
    """As if signals left the pipeline at the end of their event's hour."""
    at = fields.micros(F.col("detected_at"))
    return fields.floor_to(at, HOUR_US) + HOUR_US - at


def latency_sketch_quantiles(spark, sf_dir):
    found = rules.event_signals(logs(spark, sf_dir))
    kept = sketch.cells(found, ["signal_type"], fields.micros(F.col("detected_at")), latency_us(), DAY_US)
    return sketch.quantiles(kept, ["signal_type"])


def log_throughput(spark, sf_dir):
    return audit.throughput(logs(spark, sf_dir), HOUR_US)


BATCH = {
    f.__name__: f
    for f in (
        processed_logs, severity_counts, latency_buckets, parsed_json_lines, dead_letters,
        processing_status, regex_parsed_lines, regex_unmatched_lines, lines_by_format_table, search_logs, search_by_index,
        replayed_signals, signals_high_latency, signals_deployment_failure,
        signals_db_slow_query, signals_all, signal_counts, signals_bruteforce,
        signals_error_spike, signals_error_spike_by_host, signals_per_event,
        sliding_failure_count, rules_as_of, rules_as_of_windows, ids_of_texts, correlated_groups,
        correlated_traces, correlation_links,
        interval_links, interval_groups, interval_traces, signals_after_deployments, error_rate_by_window, zscore_anomalies,
        zscore_anomalies_dense, silence_anomalies, incident_sessions,
        session_links, incident_severity_scored, incidents_by_signal_severity,
        incidents_from_payload, incidents_latest_after_updates, incidents_missing_updates,
        incidents_found_by_id, incident_status_history, lifecycle_transitions, incidents_strict_state,
        incidents_judged, incidents_overdue, lifecycle_notices, incident_rollup, incidents_active, incidents_historical,
        incident_trend_daily, top_services, responses, playbook_coverage, action_plan_steps,
        safety_gate, safety_gate_after_allowed, responses_gated, approval_gate, failure_suppression, failure_suppressed,
        playbook_best_match, playbook_choice_as_of, escalations, execution_results, notifications_routed, notification_messages,
        notifications_rejected, notifications_count, audit_trail, audit_report,
        detection_latency_quantiles, latency_sketch_quantiles, log_throughput,
    )
}
BATCH["incidents"] = created_incidents
