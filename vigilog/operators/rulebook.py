"""Rules as data: versioned threshold and window rules from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators import windows

NUMERIC_FIELDS = ("latency_ms", "status", "cpu_percent", "memory_used_mb")
#: Compared with ``threshold_text``.
TEXT_FIELDS = ("service_name", "log_level", "message", "trace_id", "client_ip", "version", "reason")
#: What a windowed rule may count by.
KEY_FIELDS = (*TEXT_FIELDS, "event_type", "host", "username", "path")
#: Rules that are collected once and broadcast; a larger table is joined as it is.
FEW_RULES = 20_000
COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
}


def validity(rules: DataFrame) -> DataFrame:
    """Add ``valid_to``: the start of the rule's next version, of whatever kind,
    open if there is none. Versions of one start are told apart by number, and
    the highest is in force."""
    by_version = Window.partitionBy("rule_id").orderBy("valid_from", "version")
    return rules.withColumn("valid_to", F.lead("valid_from").over(by_version))


def _full(rules: DataFrame) -> DataFrame:
    """With the optional columns, null where the table has none."""
    missing = [f for f in schema.RULE_SCHEMA if f.name not in rules.columns]
    return rules.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def _problem(columns: list[str] | None) -> Column:
    """What is wrong with a rule, or null; ``columns`` are those of the logs."""
    field, key = F.col("field"), F.col("key_field")
    there = [c for c in KEY_FIELDS if columns is None or c in columns]
    fields_there = [c for c in (*NUMERIC_FIELDS, *TEXT_FIELDS) if columns is None or c in columns]
    numeric, text = field.isin(*NUMERIC_FIELDS), field.isin(*TEXT_FIELDS)
    windowed = F.col("window_s").isNotNull()
    return (
        F.when(F.col("rule_id").isNull(), "no rule_id")
        .when(F.col("valid_from").isNull(), "no valid_from")
        .when(F.col("event_type").isNull(), "no event_type")
        .when(field.isNotNull() & ~numeric & ~text, "unknown field")
        .when(field.isNotNull() & ~field.isin(*fields_there), "field not in logs")
        .when(field.isNotNull() & (F.col("op").isNull() | ~F.col("op").isin(*COMPARISONS)), "unknown op")
        .when(numeric & F.col("threshold").isNull(), "no threshold")
        .when(text & F.col("threshold_text").isNull(), "no threshold_text")
        .when(windowed & (F.col("window_s") <= 0), "window_s not above 0")
        .when(windowed & (F.col("count").isNull() | (F.col("count") < 1)), "count not at least 1")
        .when(windowed & key.isNotNull() & ~key.isin(*there), "unknown key_field")
        .when(~windowed & (F.col("count").isNotNull() | key.isNotNull()), "count or key_field without window_s")
    )


def judged(rules: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All rules in the full schema, with their ``problem`` or null."""
    return _full(rules).select(*schema.RULE_SCHEMA.fieldNames()).withColumn("problem", _problem(columns))


def rejected_rules(rules: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rules that can never be judged, each with its problem; with the ``columns``
    of the logs also those about a column that is not there."""
    return _full(rules).withColumn("problem", _problem(columns)).filter("problem is not null")


class Rulebook:
    """A checked rule table with validities, looked at once: of few rules the kinds
    and event types are known to the driver and the table is broadcast; of many,
    only the rejected ones are looked for and joins are left to the planner."""

    def __init__(self, rules: DataFrame, columns: list[str]):
        marked = validity(_full(rules)).withColumn("problem", _problem(columns))
        looked_at = marked.select("rule_id", "problem", "event_type", (F.col("window_s").isNotNull()).alias("windowed"))
        rows = looked_at.limit(FEW_RULES + 1).collect()
        self.few = len(rows) <= FEW_RULES
        bad = looked_at.filter("problem is not null").limit(5).collect() if not self.few else [
            r for r in rows if r.problem][:5]
        if bad:
            raise ValueError("invalid rules: " + ", ".join(f"{r.rule_id}: {r.problem}" for r in bad))
        self.table = marked.drop("problem")
        self._kinds = {w: sorted({r.event_type for r in rows if r.windowed == w}) for w in (False, True)}

    def of_kind(self, windowed: bool | None) -> DataFrame:
        """Its windowed rules, its per-event rules or, for None, all of them."""
        out = self.table.withColumnsRenamed(
            {"event_type": "rule_event_type", "severity": "rule_severity", "version": "rule_version"})
        if windowed is not None:
            out = out.filter("window_s is not null" if windowed else "window_s is null")
        return F.broadcast(out) if self.few else out

    def event_types(self, windowed: bool | None, most: int = 100) -> list[str] | None:
        """The event types its rules are about, None if they are more than ``most``."""
        kinds = self._kinds[windowed] if windowed is not None else sorted({*self._kinds[False], *self._kinds[True]})
        return kinds if self.few and len(kinds) <= most else None


def matched(logs: DataFrame, book: Rulebook, windowed: bool | None = None) -> DataFrame:
    """Events with each rule version, of one kind or of both, that is in force at
    their time and holds, and ``shown``, the value that was compared.

    An as-of join: equal event type, and the event's time inside the version's
    validity. A small rule table is broadcast, so events stay where they are;
    few event types become a filter of the scan.
    """
    kinds = book.event_types(windowed)
    if kinds is not None:
        logs = logs.filter(F.col("event_type").isin(kinds))
    at = F.col("timestamp")
    in_force = (at >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (at < F.col("valid_to"))
    )

    def compared(names: tuple[str, ...], limit: Column, kind: str) -> tuple[Column, Column]:
        none = F.lit(None).cast(kind)
        value = F.coalesce(none, *[F.when(F.col("field") == n, F.col(n)) for n in names if n in logs.columns])
        return value, F.coalesce(*[
            F.when(F.col("op") == op, holds(value, limit)) for op, holds in COMPARISONS.items()])

    number, by_number = compared(NUMERIC_FIELDS, F.col("threshold"), "double")
    text, by_text = compared(TEXT_FIELDS, F.col("threshold_text"), "string")
    # A rule without a field matches every event of its type.
    test = F.col("field").isNull() | F.coalesce(by_number, by_text)
    pairs = logs.join(
        book.of_kind(windowed), (F.col("event_type") == F.col("rule_event_type")) & in_force & test)
    return pairs.withColumn("shown", F.coalesce(fields.number_text(number), text))


def evaluate(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals of the table's per-event rules, each event judged by the rule
    versions in force at its time. Invalid rules are an error; see
    ``rejected_rules``. A version of the other kind ends the one before it."""
    return event_signals(matched(logs, Rulebook(rules, logs.columns), False))


def event_signals(found: DataFrame) -> DataFrame:
    """Signal rows of ``matched`` per-event rules."""
    return found.select(
        fields.signal_id(F.col("signal_type"), F.col("event_id")).alias("signal_id"),
        "signal_type",
        F.col("rule_severity").alias("severity"),
        F.col("service_name").alias("service"),
        F.when(F.col("field").isNotNull(),
               F.create_map("field", "shown")).alias("metadata"),
        F.col("timestamp").alias("detected_at"),
        "event_id",
        F.lit(None).cast("int").alias("rule_order"),
        "rule_id",
        F.col("rule_version").alias("version"),
    )


def window_matches(logs: DataFrame, book: Rulebook) -> DataFrame:
    """The events that the windowed rule versions in force count, one row for each
    version: ``run_rule`` names it, ``run_key`` is what it counts by. Events whose
    key is null or empty do not count."""
    return counted(matched(logs, book, True).withColumn("counts_by", counts_by(logs.columns)))


def counts_by(columns: list[str]) -> Column:
    """What a windowed rule counts an event by."""
    return F.coalesce(*[F.when(F.col("key_field") == n, F.col(n).cast("string"))
                        for n in KEY_FIELDS if n in columns], F.lit(None).cast("string"))


def counted(found: DataFrame, *more: str) -> DataFrame:
    """``window_matches`` of rows of ``matched`` that have ``counts_by``, with ``more``
    of their columns."""
    return found.filter(F.col("key_field").isNull() | (F.coalesce("counts_by", F.lit("")) != "")).select(
        version_key().alias("run_rule"), F.coalesce("counts_by", F.lit("")).alias("run_key"),
        "event_id", "service_name", "timestamp", fields.micros(F.col("timestamp")).alias("us"),
        "rule_id", F.col("rule_version").alias("version"), "signal_type",
        F.col("rule_severity").alias("severity"), "key_field", "count", *more,
    )


def version_key(version: str = "rule_version") -> Column:
    """A text for a rule version that has no control characters of its own."""
    return fields.digest(F.col("rule_id"), F.col(version), F.col("valid_from"))


def window_settings(book: Rulebook) -> dict[str, tuple[int, int]]:
    """Count and window in microseconds of every windowed version, by its key;
    a pair of numbers for each, on the driver."""
    rows = book.of_kind(True).select(version_key().alias("key"), "count", "window_s").collect()
    return {r.key: (r["count"], r.window_s * 1_000_000) for r in rows}


def as_window_signals(fired: DataFrame) -> DataFrame:
    """Signal rows of the rows of ``window_matches`` on which a version fired."""
    shown = F.when(F.col("key_field").isNotNull(), F.create_map("key_field", "run_key")).otherwise(
        F.create_map(F.lit("count"), F.col("count").cast("string")))
    return fired.select(
        fields.signal_id(F.col("signal_type"), F.col("event_id")).alias("signal_id"),
        "signal_type", "severity", F.col("service_name").alias("service"), shown.alias("metadata"),
        F.col("timestamp").alias("detected_at"), "event_id", F.lit(None).cast("int").alias("rule_order"),
        "rule_id", "version",
    )


def evaluate_windows(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals of the table's windowed rules; each version counts on its own. One
    scan, one join and one shuffle for any number of rules."""
    book = Rulebook(rules, logs.columns)
    settings = window_settings(book)
    found = window_matches(logs, book)
    if not settings:
        return as_window_signals(found)
    return as_window_signals(windows.emit_and_reset_rules(found, "run_key", "us", "event_id", settings))
