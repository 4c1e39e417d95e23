"""Registered streaming queries: the whole ``events`` table as a stream, run
to its end, then the resulting table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilog.functions import fields
from vigilog.operators import process, rules, sketch
from vigilog.operators.anomaly import flagged
from vigilog.plans.queries import (
    ANOMALY_COLUMNS, BRUTE, CHANNELS, DEADLINES, GATES, SPIKE, executed, incidents, latency_us, planned, protected_services, rule_table,
    signal_incidents, step_columns, updates, us,
)
from vigilog.session import scratch
from vigilog.sources import event_table, tables
from vigilog.streaming import anomaly, gates, incremental, lifecycle, pipeline, rulebook, sessions, stateful, store

HOUR_US = 3_600_000_000


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table.as_logs(event_table.stream_events(spark, sf_dir))


def _table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    root = scratch(spark, name)
    pipeline.append(df, root, "out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _to_the_end(spark: SparkSession, rows: DataFrame, build, name: str, **mark) -> DataFrame:
    """The table of ``build(rows)`` after all rows and the end mark."""
    root = scratch(spark, name)
    marks = f"{root}/marks"

    def run() -> DataFrame:
        df = build(pipeline.with_end_marks(rows, marks))
        pipeline.append(df, root, "out").awaitTermination()
        return df

    run()
    pipeline.end_mark(spark, rows.schema, marks, **mark)
    return spark.read.schema(run().schema).parquet(f"{root}/out")


def stream_processed_counts(spark, sf_dir):
    done = process.process_logs(_logs(spark, sf_dir)).select("normalized_type", "severity")
    return _table(spark, done, "processed").groupBy("normalized_type", "severity").agg(
        F.count("*").alias("events"))


def stream_signals(spark, sf_dir):
    found = rules.event_signals(_logs(spark, sf_dir))
    return _table(spark, found, "signals").select(
        "signal_id", "signal_type", "severity", "service", us("detected_at"))


def stream_bruteforce(spark, sf_dir):
    """Keyed state, with an end mark after the last row."""
    rule = rules.brute_force_rule(**BRUTE)
    found = _to_the_end(
        spark, _logs(spark, sf_dir), lambda logs: stateful.window_signals(logs, rule, "1 hour"), "bruteforce",
        event_type=rule.event_type, client_ip="end", timestamp=pipeline.END)
    return found.select("event_id", "service", us("detected_at"), F.col("metadata")["ip"].alias("ip"))


def stream_error_spike(spark, sf_dir):
    """One count over the whole stream, without a single-task state."""
    root = scratch(spark, "spike")
    rule = rules.error_spike_rule(**SPIKE)
    for query in pipeline.detect(_logs(spark, sf_dir), root, "1 hour", [rule]):
        query.awaitTermination()
    own = f"{root}/windows_{rule.signal_type.lower()}"
    found = incremental.read_signals(spark, own).unionByName(incremental.remaining_signals(spark, own, rule))
    return found.select("event_id", "service", us("detected_at"))


def stream_zscore_anomalies(spark, sf_dir):
    """Silent hours included, from a stream in two parts of time."""
    root = scratch(spark, "anomalies")
    logs = event_table.read_logs(spark, sf_dir).select("service_name", "timestamp", "log_level")
    second = F.col("timestamp") >= "2024-01-14"
    watch = anomaly.Watch(HOUR_US, 2 * HOUR_US, 24, {"threshold": 3})
    for part in (~second | F.col("timestamp").isNull(), second):
        logs.filter(part).write.mode("append").parquet(f"{root}/feed")
        anomaly.follow(pipeline.follow(spark, root, "feed"), f"{root}/out", watch).awaitTermination()
    found = anomaly.scored(spark, f"{root}/out").unionByName(anomaly.remaining(spark, f"{root}/out", watch))
    return flagged(found).select(*ANOMALY_COLUMNS)


def stream_latency_quantiles(spark, sf_dir):
    """Cells of the micro-batches of a stream, added up."""
    root = scratch(spark, "latencies")
    sketch.follow(
        rules.event_signals(_logs(spark, sf_dir)), root, ["signal_type"], fields.micros(F.col("detected_at")),
        latency_us(), 24 * HOUR_US).awaitTermination()
    return sketch.quantiles(sketch.stored(spark, root), ["signal_type"])


def stream_rule_changes(spark, sf_dir):
    """Rules of both kinds over a stream that is half through when new versions are
    published, which takes it to a restart."""
    root = scratch(spark, "rule-changes")
    rows = event_table.read_logs(spark, sf_dir)
    for first, last in ((None, "2024-01-11"), ("2024-01-11", None)):
        part = rows.filter(F.col("timestamp") >= first) if first else rows.filter(
            F.col("timestamp").isNull() | (F.col("timestamp") < last))
        part.write.mode("append").parquet(f"{root}/feed")
        published = rule_table(spark) if last is None else rule_table(spark).filter(F.col("valid_from") < last)
        rulebook.signals_while_rules_change(
            pipeline.follow(spark, root, "feed"), lambda: published, f"{root}/out", HOUR_US).awaitTermination()
    found = rulebook.read_signals(spark, f"{root}/out").unionByName(rulebook.remaining_signals(spark, f"{root}/out"))
    return found.select("rule_id", "version", "signal_type", "severity", "event_id", us("detected_at"))


def stream_error_rates(spark, sf_dir):
    return _to_the_end(
        spark, _logs(spark, sf_dir), lambda logs: pipeline.error_rates(logs, "1 hour", "1 hour"), "rates",
        timestamp=pipeline.END)


#: Longer than all these events: rows of any order meet.
ANY_ORDER_US = 400 * 24 * HOUR_US


def _sessions(spark: SparkSession, sf_dir: str) -> str:
    """The sessions of all signals that come in two parts, neither in order of time."""
    root = scratch(spark, "sessions")
    found = rules.event_signals(event_table.read_logs(spark, sf_dir))
    found.repartition(2, "signal_id").write.parquet(f"{root}/signals")
    sessions.follow(
        pipeline.follow(spark, root, "signals", max_files=1), f"{root}/out", HOUR_US, ANY_ORDER_US).awaitTermination()
    return f"{root}/out"


def stream_incident_sessions(spark, sf_dir):
    """Sessions that late rows lengthen and join."""
    return sessions.sessions(spark, _sessions(spark, sf_dir)).select(
        "incident_id", "service", "error", "status", "priority", "occurrence_count", "created_us", "updated_us",
        F.col("context_data")["first_signal"].alias("first_signal"),
        F.col("context_data")["last_signal"].alias("last_signal"))


def stream_session_links(spark, sf_dir):
    return sessions.session_links(spark, _sessions(spark, sf_dir), HOUR_US)


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A batch result as a stage table, followed as a stream."""
    root = scratch(spark, name)
    df.write.parquet(f"{root}/{name}")
    return pipeline.follow(spark, root, name)


def stream_lifecycle(spark, sf_dir):
    """Openings and updates of all incidents through the state machine, to the
    end of all deadlines."""
    opened = incidents(spark, sf_dir, stored=True)
    rows = _stored(spark, lifecycle.changes(opened, updates(opened)), "changes")
    steps = _to_the_end(
        spark, rows, lambda r: lifecycle.judged(r, "1 hour", deadlines_s=DEADLINES), "steps",
        id="end", status="open", seq=-1, opens=0, changed_at=pipeline.END)
    return step_columns(steps)


def stream_response_gates(spark, sf_dir):
    """Planned responses and outcomes of all incidents through the gates."""
    opened = signal_incidents(spark, sf_dir, stored=True)
    rows = _stored(spark, gates.attempts_and_outcomes(planned(opened), executed(opened)), "attempts")
    found = _to_the_end(
        spark, rows, lambda r: gates.gated(r, "1 hour", protected=protected_services(spark), **GATES), "gated",
        service="end", action="end", kind=gates.ATTEMPT, incident_id="end", at=pipeline.END)
    return found.select(
        "incident_id", "service", "action", "error", "us", "attempts", "in_cooldown", "suppressed", "decision")


def stream_incident_store(spark, sf_dir):
    """The last state of all incidents, from openings and updates in micro-batches."""
    opened = incidents(spark, sf_dir, stored=True)
    feed = store.changes(opened, updates(opened)).repartition(4)
    root = scratch(spark, "store")
    feed.write.parquet(f"{root}/feed")
    kept = store.IncidentStore(spark, f"{root}/kept", buckets=16)
    kept.follow(pipeline.follow(spark, root, "feed", max_files=2)).awaitTermination()
    return kept.state().select(
        "id", "service", "error", "severity", "status", us("created_at", "created_us"), us("changed_at", "changed_us"))


def stream_stage_tables(spark, sf_dir):
    """Lines to notifications through every stage table."""
    root = scratch(spark, "stages")
    lines = event_table.as_json_lines(event_table.read_logs(spark, sf_dir)).select("value")
    lines.write.text(f"{root}/lines")
    pipeline.ingest(
        tables.stream_log_files(spark, f"{root}/lines", ".txt"), root).awaitTermination()
    for query in pipeline.process_raw(pipeline.follow(spark, root, "raw_logs"), root):
        query.awaitTermination()
    logs = pipeline.follow(spark, root, "processed_logs")
    pipeline.append(
        pipeline.emitted(rules.event_signals(logs)), root, "signals").awaitTermination()
    pipeline.open_incidents(pipeline.follow(spark, root, "signals"), root).awaitTermination()
    opened = pipeline.follow(spark, root, "incidents")
    pipeline.plan_responses(opened, tables.playbooks(spark), root).awaitTermination()
    pipeline.send_notifications(opened, CHANNELS, root).awaitTermination()

    def rows(table: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{table}").agg(F.count("*").alias("n_rows")).select(
            F.lit(table).alias("stage"), "n_rows")

    stages = ["raw_logs", "dead_letters", "processed_logs", "signals", "incidents", "responses",
              "notifications"]
    out = rows(stages[0])
    for stage in stages[1:]:
        out = out.unionByName(rows(stage))
    return out


def stream_tailed_lines(spark, sf_dir):
    """Lines read by byte offset from growing files."""
    root = scratch(spark, "tail")
    lines = event_table.as_json_lines(event_table.read_logs(spark, sf_dir)).select("value")
    lines.write.text(f"{root}/lines")
    tailed = tables.tail_log_files(spark, f"{root}/lines", ".txt")
    return _table(spark, process.process_lines(tailed).select("event_id", "normalized_type"),
                  "tailed")


STREAM = {
    f.__name__: f
    for f in (
        stream_processed_counts, stream_signals, stream_bruteforce, stream_error_spike, stream_rule_changes, stream_zscore_anomalies, stream_latency_quantiles,
        stream_error_rates, stream_incident_sessions, stream_session_links, stream_lifecycle, stream_response_gates, stream_incident_store, stream_stage_tables, stream_tailed_lines,
    )
}
