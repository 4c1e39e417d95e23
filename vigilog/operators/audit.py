"""One trail of everything that happened, and measures of the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fields


def entries(
    rows: DataFrame, component: str, incident_id: str, at: str, action: Column, outcome: Column
) -> DataFrame:
    """Any table's rows in the audit shape, with repeatable ids."""
    out = rows.select(
        F.col(incident_id).alias("incident_id"),
        F.col(at).alias("timestamp"),
        F.lit(component).alias("component_name"),
        action.alias("action_performed"),
        outcome.alias("outcome"),
    )
    audit_id = fields.digest(
        F.lit("audit"), F.col("component_name"), F.col("incident_id"),
        fields.micros(F.col("timestamp")).cast("string"), F.col("action_performed"),
        F.col("outcome"),
    )
    return out.withColumn("audit_id", audit_id)


def audit_trail(
    incidents: DataFrame | None = None,
    responses: DataFrame | None = None,
    approvals: DataFrame | None = None,
    notices: DataFrame | None = None,
) -> DataFrame:
    """Incidents, actions, approvals and notices as one table, unordered."""
    parts = []
    if incidents is not None:
        parts.append(entries(
            incidents, "incidents", "id", "created_at", F.lit("created"), F.col("severity")))
    if responses is not None:
        # Executed ones at the time they ran, planned ones at their incident's.
        at = "executed_at" if "executed_at" in responses.columns else "created_at"
        parts.append(entries(
            responses, "responses", "incident_id", at, F.col("action"), F.col("status")))
    if approvals is not None:
        parts.append(entries(
            approvals, "approvals", "incident_id", "decided_at", F.col("action"),
            F.when(F.col("approved"), "approved").otherwise("denied")))
    if notices is not None:
        parts.append(entries(
            notices, "notifications", "id", "changed_at", F.col("notice"), F.col("status")))
    return reduce(DataFrame.unionByName, parts)


def report(trail: DataFrame, incident_id: str | None = None) -> DataFrame:
    """The trail by incident and time, of one incident if given."""
    rows = trail if incident_id is None else trail.filter(F.col("incident_id") == incident_id)
    return rows.orderBy("incident_id", "timestamp", "component_name", "audit_id")


def throughput(logs: DataFrame, window_us: int) -> DataFrame:
    """Log rows per window, with the number of distinct services."""
    at = fields.floor_to(fields.micros(F.col("timestamp")), window_us)
    per_service = logs.groupBy(at.alias("window_start_us"), "service_name").agg(
        F.count("*").alias("n")
    )
    return per_service.groupBy("window_start_us").agg(
        F.sum("n").alias("events"),
        F.count("*").alias("services"),
        F.round(F.sum("n") / (window_us / 1_000_000), 6).alias("events_per_second"),
    )


def detection_latency(
    signals: DataFrame, emitted_us: Column, points: tuple[float, ...] = (0.5, 0.95, 0.99),
    resolution_us: int = 1000,
) -> DataFrame:
    """Quantiles of the seconds from an event to its signal, per signal type.

    Counted per ``resolution_us`` first, by which figures are at most too low, so
    the quantiles work on a histogram.
    """
    late = emitted_us - fields.micros(F.col("detected_at"))
    step = F.floor(late / resolution_us)
    counts = signals.groupBy("signal_type", step.alias("_step")).agg(F.count("*").alias("n"))
    names = [f"p{round(p * 100)}" for p in points]
    unit = resolution_us / 1_000_000
    return counts.groupBy("signal_type").agg(
        F.sum("n").alias("signals"),
        (F.max("_step") * unit).alias("max_s"),
        *[(F.percentile("_step", p, F.col("n")) * unit).alias(n) for p, n in zip(points, names)],
    )


def progress_rows(query) -> list[dict]:
    """Recent progress of a streaming query as plain rows, for a metrics table."""
    return [
        {
            "batch_id": p["batchId"],
            "at": p["timestamp"],
            "input_rows": p["numInputRows"],
            "rows_per_second": p.get("processedRowsPerSecond"),
            "state_rows": sum(s["numRowsTotal"] for s in p.get("stateOperators", [])),
        }
        for p in query.recentProgress
    ]
