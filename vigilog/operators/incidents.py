"""Incidents: creation, current state, lifecycle, scoring, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog import schema
from vigilog.functions import classify, fields
from vigilog.operators.ordered import ranged, with_previous

STATE_COLUMNS = ["id", "service", "error", "severity", "status", "created_at"]


def create_incidents(signals: DataFrame, severity_source: str = "error") -> DataFrame:
    """One open incident per signal.

    Severity comes from the error's name, or with ``severity_source="signal"``
    from the signal. Signal severity and evidence are kept beside it.
    """
    severity = (
        F.lower("severity") if severity_source == "signal"
        else classify.error_severity(F.col("signal_type"))
    )
    return signals.select(
        fields.incident_id(F.col("signal_id")).alias("id"),
        "service",
        F.col("signal_type").alias("error"),
        severity.alias("severity"),
        F.lit("open").alias("status"),
        F.col("detected_at").alias("created_at"),
        "signal_id",
        F.col("severity").alias("signal_severity"),
        F.col("metadata").alias("evidence"),
    )


def incidents_from_payload(payloads: DataFrame, column: str = "signals") -> DataFrame:
    """Bulk input: an array of ``struct(service, signal_type, ...)`` per row.

    ``payload_id`` and the place in the array give the order and the id.
    """
    rows = payloads.select("payload_id", F.posexplode(column).alias("place", "s"))
    return rows.select(
        fields.incident_id(
            fields.digest(F.col("payload_id").cast("string"), F.col("place").cast("string"))
        ).alias("id"),
        F.col("s.service").alias("service"),
        F.col("s.signal_type").alias("error"),
        classify.error_severity(F.col("s.signal_type")).alias("severity"),
        F.lit("open").alias("status"),
        "payload_id",
        "place",
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last status per id; partly aggregated before the shuffle."""
    last = F.max_by("status", F.struct("changed_at", "seq"))
    return updates.groupBy("id").agg(last.alias("_status"), F.max("changed_at").alias("_changed"))


def current_state(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Incidents with their last status; updates of unknown ids do nothing.

    ``updates`` has ``id, status, changed_at, seq``; any status text is taken.
    """
    return (
        incidents.join(latest_updates(updates), "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumnRenamed("_changed", "changed_at")
        .drop("_status")
    )


def latest_by_key(changes: DataFrame, key: str = "id") -> DataFrame:
    """Last write wins over an append-only change table with
    ``changed_at, seq`` and the row's columns."""
    rest = [c for c in changes.columns if c != key]
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct("changed_at", "seq")).alias("_row"))
        .select(key, "_row.*")
    )


def missing_updates(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose incident does not exist."""
    return updates.join(incidents.select("id"), "id", "left_anti")


def get_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.filter(F.col("id") == incident_id)


def get_incidents(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    return incidents.join(ids.select("id").distinct(), "id", "left_semi")


def status_changes(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """All states an incident went through, the opening one first."""
    opened = incidents.select(
        "id", "status", F.col("created_at").alias("changed_at"), F.lit(-1).cast("bigint").alias("seq")
    )
    known = updates.join(incidents.select("id"), "id", "left_semi")
    return opened.unionByName(
        known.select("id", "status", "changed_at", F.col("seq").cast("bigint").alias("seq"))
    )


def transitions(changes: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Each status change with the status before it and whether the lifecycle
    allows the step."""
    allowed = schema.LIFECYCLE if allowed is None else allowed
    steps = [f"{a}>{b}" for a, following in allowed.items() for b in following]
    order = ["_opens", "changed_at", "seq"]
    rows = changes.withColumn("_opens", F.when(F.col("seq") < 0, 0).otherwise(1))
    step = F.concat_ws(">", F.lower("previous"), F.lower("status"))
    return (
        with_previous(rows, ["id"], order, {"status": "previous"})
        .drop("_opens")
        .withColumn(
            "verdict",
            F.when(F.col("previous").isNull(), "opened")
            .when(F.lower("previous") == F.lower("status"), "unchanged")
            .when(step.isin(steps), "valid")
            .otherwise("rejected"),
        )
    )


def strict_state(
    incidents: DataFrame, updates: DataFrame, allowed: dict[str, list[str]] | None = None
) -> DataFrame:
    """Incidents with the status they reach when steps the lifecycle does not
    allow are ignored.

    A sequence of updates turns each state into some state, and such small
    tables of states combine in order. So updates are folded per range of a
    range partitioning, for every state they might begin in, and one incident
    may have any number of them.
    """
    allowed = schema.LIFECYCLE if allowed is None else allowed
    states = [F.lit(s) for s in allowed]
    steps = F.array(*[F.lit(f"{a}>{b}") for a, later in allowed.items() for b in later])
    known = updates.join(incidents.select("id"), "id", "left_semi").select(
        "id", F.lower("status").alias("next"), "changed_at", "seq"
    )
    rows = ranged(known, ["id"], ["changed_at", "seq"])

    def follow(table: Column, row: Column) -> Column:
        to = row["next"]
        return F.transform(
            table, lambda s: F.when(F.array_contains(steps, F.concat(s, F.lit(">"), to)), to)
            .otherwise(s)
        )

    in_order = F.array_sort(F.collect_list(F.struct("changed_at", "seq", "_copy", "next")))
    tables = rows.groupBy("_range", "id").agg(in_order.alias("_rows")).select(
        "id", "_range", F.aggregate("_rows", F.array(*states), follow).alias("_table")
    )
    # At most one table per range.
    chains = tables.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_range", "_table"))).alias("_chain")
    )
    joined = incidents.join(chains, "id", "left")
    none = F.array().cast(chains.schema["_chain"].dataType)
    final = F.aggregate(
        F.coalesce("_chain", none),
        F.lower("status"),
        lambda s, part: F.coalesce(
            F.get(part["_table"], F.array_position(F.array(*states), s).cast("int") - 1), s
        ),
    )
    return joined.withColumn("status", final).drop("_chain")


def close(ids: DataFrame, changed_at: Column) -> DataFrame:
    """Update rows that resolve the given incidents."""
    return _update(ids, "resolved", changed_at)


def escalate(ids: DataFrame, changed_at: Column) -> DataFrame:
    return _update(ids, "escalated", changed_at)


def _update(ids: DataFrame, status: str, changed_at: Column) -> DataFrame:
    return ids.select(
        "id", F.lit(status).alias("status"), changed_at.alias("changed_at"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def score_severity(
    sessions: DataFrame,
    groups: DataFrame,
    window_us: int,
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
    full_frequency: int = 20,
    n_services: int = len(schema.SERVICES),
) -> DataFrame:
    """Severity from error frequency, impact on services and confidence.

    The documents name the three inputs, the formula is ours: each is brought
    to [0, 1] and weighted. Impact and confidence come from the time window in
    which the incident began.
    """
    frequency = F.least(F.lit(1.0), F.col("occurrence_count") / full_frequency)
    impact = F.coalesce(F.col("n_services"), F.lit(0)) / n_services
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    score = F.round(
        frequency * weights[0] + impact * weights[1] + confidence * weights[2], 6
    )
    start = fields.floor_to(F.col("created_us"), window_us)
    context = groups.select("window_start_us", "n_services", "confidence")
    return (
        sessions.withColumn("window_start_us", start)
        .join(context, "window_start_us", "left")
        .withColumn("score", score)
        .withColumn(
            "scored_severity",
            F.when(F.col("score") >= 0.75, "CRITICAL")
            .when(F.col("score") >= 0.5, "HIGH")
            .when(F.col("score") >= 0.25, "MEDIUM")
            .otherwise("LOW"),
        )
    )


def severity_rollup(incidents: DataFrame) -> DataFrame:
    """Counts by severity and service with subtotals."""
    return incidents.rollup("severity", "service").agg(
        F.count("*").alias("incidents"),
        F.grouping_id().alias("level"),
        F.count_if(F.lower("status") != "resolved").alias("active"),
    )


def active(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.lower("status") != "resolved")


def historical(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.lower("status") == "resolved")


def daily_trend(incidents: DataFrame) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd")
    return incidents.groupBy(day.alias("day"), "error").agg(F.count("*").alias("incidents"))


def top_services(incidents: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` services with most incidents, ties by name."""
    return (
        incidents.groupBy("service")
        .agg(F.count("*").alias("incidents"))
        .orderBy(F.desc("incidents"), "service")
        .limit(k)
    )
