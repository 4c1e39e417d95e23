"""Severity-routed notifications as rows, one per incident and channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import classify, fields
from vigilog.operators.ordered import with_previous

REQUIRED = ["incident_id", "service", "severity", "event_type", "timestamp"]


@dataclass(frozen=True)
class Channels:
    """Where alerts may go; an empty value means not configured."""

    webhook_url: str = ""
    email_enabled: bool = False
    smtp_user: str = ""
    smtp_password: str = ""
    email_to: str = ""

    @property
    def email_ready(self) -> bool:
        return bool(self.smtp_user and self.smtp_password and self.email_to)


def from_incidents(incidents: DataFrame) -> DataFrame:
    """Incident rows in the shape notifications are made from."""
    return incidents.select(
        F.col("id").alias("incident_id"),
        "service",
        "severity",
        F.col("error").alias("event_type"),
        fields.iso_millis(F.col("created_at")).alias("timestamp"),
        F.lit(None).cast("string").alias("message"),
    )


def _complete() -> Column:
    return F.concat(*REQUIRED).isNotNull()


def accepted(inputs: DataFrame) -> DataFrame:
    return inputs.filter(_complete())


def rejected(inputs: DataFrame) -> DataFrame:
    absent = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    return inputs.filter(~_complete()).withColumn("missing", F.concat_ws(",", *absent))


def route(inputs: DataFrame) -> DataFrame:
    """``alert`` for high and critical severities in any letter case, else ``log``."""
    return accepted(inputs).withColumn(
        "route", F.when(classify.is_alert(F.col("severity")), "alert").otherwise("log")
    )


def _line(label: str, column: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.col(column))


def subject() -> Column:
    return F.concat(F.lit("[INCIDENT] "), F.col("severity"), F.lit(" - "), F.col("service"))


# The text layout of the two messages, a blank first line and a
# final line break included.
EMAIL_TITLE = "Incident Alert"
WEBHOOK_TITLE = "\U0001f6a8 INCIDENT ALERT"


def email_body() -> Column:
    return F.concat_ws(
        "\n",
        F.lit(""), F.lit(EMAIL_TITLE), F.lit(""),
        _line("Service", "service"), _line("Severity", "severity"),
        _line("Event", "event_type"), _line("Time", "timestamp"),
        F.lit(""), F.lit("Message:"), F.coalesce("message", F.lit("")), F.lit(""),
    )


def webhook_text() -> Column:
    return F.concat_ws(
        "\n",
        F.lit(""), F.lit(WEBHOOK_TITLE), F.lit(""),
        _line("Service", "service"), _line("Severity", "severity"),
        _line("Type", "event_type"), _line("Time", "timestamp"), F.lit(""),
    )


def fan_out(inputs: DataFrame, channels: Channels) -> DataFrame:
    """Alerts times channels. Each row stands alone: a channel that is skipped
    or later fails does not touch the others."""
    def channel(name: str, ready: bool, title: Column, text: Column) -> Column:
        return F.struct(
            F.lit(name).alias("channel"),
            F.lit("planned" if ready else "skipped").alias("delivery_state"),
            title.alias("subject"),
            text.alias("body"),
        )

    targets = [
        channel("webhook", bool(channels.webhook_url), F.lit(None).cast("string"), webhook_text())
    ]
    if channels.email_enabled:
        targets.append(channel("email", channels.email_ready, subject(), email_body()))
    return (
        route(inputs)
        .filter("route = 'alert'")
        .withColumn("_c", F.explode(F.array(*targets)))
        .select("incident_id", "service", "severity", "event_type", "timestamp", "_c.*")
    )


def sent_count(inputs: DataFrame) -> DataFrame:
    """Accepted notifications of any severity."""
    return accepted(inputs).agg(F.count("*").alias("notifications_sent"))


def lifecycle_notices(changes: DataFrame) -> DataFrame:
    """A notice for each real change of an incident's status.

    ``changes`` is ``incidents.status_changes``: created, then updated,
    escalated or resolved; a repeated status gives none.
    """
    rows = changes.withColumn("_opens", F.when(F.col("seq") < 0, 0).otherwise(1))
    now = F.lower("status")
    return (
        with_previous(rows, ["id"], ["_opens", "changed_at", "seq"], {"status": "previous"})
        .filter(F.col("previous").isNull() | (F.lower("previous") != now))
        .withColumn(
            "notice",
            F.when(F.col("previous").isNull(), "created")
            .when(now.isin("resolved", "escalated"), now)
            .otherwise("updated"),
        )
        .drop("_opens")
    )
