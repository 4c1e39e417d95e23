"""Per-event detection rules and the union of all rule outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators import windows

SIGNAL_COLUMNS = schema.SIGNAL_SCHEMA.fieldNames()


@dataclass(frozen=True)
class EventRule:
    """Fires on each event for which ``when`` holds."""

    order: int
    signal_type: str
    severity: str
    event_type: str
    when: Callable[[], Column]
    evidence: Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class WindowRule:
    """Fires on every ``count``-th matching event inside ``window_s``, then
    starts counting afresh. Without ``key`` all events share one count.
    ``evidence`` may use the key columns."""

    order: int
    signal_type: str
    severity: str
    event_type: str
    when: Callable[[], Column]
    count: int
    window_s: float
    key: tuple[str, ...] = ()
    evidence: Callable[[], dict[str, Column]] = field(default=dict)

    @property
    def window_us(self) -> int:
        return int(self.window_s * 1_000_000)


def _latency_above(threshold: float) -> Column:
    """An absent latency counts as 0."""
    latency = F.col("latency_ms")
    return latency > threshold if threshold >= 0 else F.coalesce(latency, F.lit(0.0)) > threshold


def latency_rule(threshold: float = schema.HIGH_LATENCY_MS) -> EventRule:
    return EventRule(
        2, "HIGH_LATENCY", "MEDIUM", "http.request",
        lambda: _latency_above(threshold),
        lambda: {"latency_ms": fields.number_text(F.col("latency_ms"))},
    )


def deployment_failure_rule() -> EventRule:
    return EventRule(
        4, "DEPLOYMENT_FAILURE", "HIGH", "deployment.failed",
        lambda: F.lit(True),
        lambda: {"version": F.col("version"), "reason": F.col("reason")},
    )


def slow_query_rule(
    threshold: float = schema.SLOW_QUERY_MS, event_type: str = "db.query"
) -> EventRule:
    return EventRule(
        5, "DB_SLOW_QUERY", "MEDIUM", event_type,
        lambda: _latency_above(threshold),
        lambda: {"latency_ms": fields.number_text(F.col("latency_ms"))},
    )


def brute_force_rule(
    count: int = schema.LOGIN_FAILURES, window_s: float = schema.LOGIN_WINDOW_S
) -> WindowRule:
    return WindowRule(
        3, "BRUTE_FORCE_LOGIN", "HIGH", "auth.login_failed",
        lambda: F.col("client_ip").isNotNull() & (F.col("client_ip") != ""),
        count, window_s, ("client_ip",),
        lambda: {"ip": F.col("client_ip")},
    )


def error_spike_rule(
    count: int = schema.HTTP_ERRORS,
    window_s: float = schema.HTTP_WINDOW_S,
    key: tuple[str, ...] = (),
) -> WindowRule:
    """``key=("service_name",)`` counts per service instead of overall."""
    return WindowRule(
        1, "HTTP_ERROR_SPIKE", "HIGH", "http.request",
        lambda: F.col("status") >= 500,
        count, window_s, key,
        lambda: {"count": F.lit(count)},
    )


def event_rules() -> list[EventRule]:
    return [latency_rule(), deployment_failure_rule(), slow_query_rule()]


def window_rules() -> list[WindowRule]:
    return [error_spike_rule(), brute_force_rule()]


def matches(rule: EventRule | WindowRule) -> Column:
    return (F.col("event_type") == rule.event_type) & rule.when()


def candidates(logs: DataFrame, rules: list[EventRule] | list[WindowRule]) -> DataFrame:
    """The events some rule wants, by predicates that reach the table scan."""
    types = sorted({rule.event_type for rule in rules})
    wanted = reduce(lambda a, b: a | b, [matches(rule) for rule in rules])
    return logs.filter(F.col("event_type").isin(types)).filter(wanted)


def _as_signal(events: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """Rows with an event and its ``hit`` struct to signal rows."""
    return events.select(
        fields.signal_id(F.col("hit.signal_type"), F.col("event_id")).alias("signal_id"),
        "hit.signal_type",
        "hit.severity",
        F.col("service_name").alias("service"),
        "hit.metadata",
        F.col("timestamp").alias("detected_at"),
        "event_id",
        "hit.rule_order",
        *context,
    )


def _hit(rule: EventRule | WindowRule) -> Column:
    return F.struct(
        F.lit(rule.signal_type).alias("signal_type"),
        F.lit(rule.severity).alias("severity"),
        fields.text_map(**rule.evidence()).alias("metadata"),
        F.lit(rule.order).alias("rule_order"),
    )


def event_signals(
    logs: DataFrame, rules: list[EventRule] | None = None, context: tuple[str, ...] = ()
) -> DataFrame:
    """All per-event rules in one pass over the events; no shuffle.

    ``context`` names further event columns to keep, such as ``trace_id``.
    """
    rules = event_rules() if rules is None else rules
    hits = F.array_compact(F.array(*[F.when(matches(r), _hit(r)) for r in rules]))
    columns = ["event_id", "service_name", "timestamp", *context]
    return _as_signal(
        candidates(logs, rules).select(*columns, F.explode(hits).alias("hit")), context
    )


def rule_matches(logs: DataFrame, rule: WindowRule) -> DataFrame:
    """The events one window rule counts, with its key columns."""
    return candidates(logs, [rule]).select(
        "event_id", "service_name", "timestamp",
        *[c for c in rule.key if c != "service_name"],
        fields.micros(F.col("timestamp")).alias("us"),
        windows.run_key(rule.key).alias("run_key"),
    )


def window_signals(
    logs: DataFrame, *rules: WindowRule, context: tuple[str, ...] = ()
) -> DataFrame:
    """Signals of windowed rules: one scan and one shuffle for all of them."""
    named = {str(i): rule for i, rule in enumerate(rules)}
    columns = ["event_id", "service_name", "timestamp", *context]
    keys = sorted({c for rule in rules for c in rule.key} - set(columns))
    runs = [
        F.when(
            matches(rule),
            F.struct(
                F.lit(name).alias("run_rule"), windows.run_key(rule.key).alias("run_key")
            ),
        )
        for name, rule in named.items()
    ]
    counted = (
        candidates(logs, list(rules))
        .select(*columns, *keys, F.explode(F.array_compact(F.array(*runs))).alias("run"))
        .select(*columns, *keys, "run.*", fields.micros(F.col("timestamp")).alias("us"))
    )
    fired = windows.emit_and_reset_rules(
        counted, "run_key", "us", "event_id",
        {name: (rule.count, rule.window_us) for name, rule in named.items()},
    )
    hit = F.coalesce(*[F.when(F.col("run_rule") == n, _hit(r)) for n, r in named.items()])
    return _as_signal(fired.withColumn("hit", hit), context)


def window_hits(fired: DataFrame, rule: WindowRule) -> DataFrame:
    """Signal rows of the events on which a window rule fired."""
    return _as_signal(fired.withColumn("hit", _hit(rule)))


def detect(
    logs: DataFrame,
    rules: list[EventRule] | None = None,
    windowed: list[WindowRule] | None = None,
    context: tuple[str, ...] = (),
) -> DataFrame:
    """Signals of every rule; ``rule_order`` tells the order within one event."""
    windowed = window_rules() if windowed is None else windowed
    out = event_signals(logs, rules, context)
    if windowed:
        out = out.unionByName(window_signals(logs, *windowed, context=context))
    return out


def signals_per_event(logs: DataFrame, signals: DataFrame) -> DataFrame:
    """Each event with its list of signals in rule order, empty when none fired.

    Copies of an event share its id, so their equal signals are folded first;
    a list then has at most one signal per rule.
    """
    parts = ["rule_order", "signal_type", "severity", "signal_id"]
    listed = (
        signals.select("event_id", *parts)
        .distinct()
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("signals"))
    )
    empty = F.array().cast(listed.schema["signals"].dataType)
    return (
        logs.select("event_id")
        .join(listed, "event_id", "left")
        .withColumn("signals", F.coalesce("signals", empty))
    )
