"""Ordered case expressions: event kind, latency bucket, severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vigilog import schema


def normalised(event_type: Column, status: Column) -> Column:
    """``struct(normalized_type, severity)``; an absent status reads as 200."""
    code = F.coalesce(status, F.lit(200))

    def kind(name, severity):
        return F.struct(
            F.lit(name).alias("normalized_type"), F.lit(severity).alias("severity")
        )

    http = event_type == "http.request"
    return (
        F.when(event_type == "auth.login_failed", kind("AUTH_FAILURE", "HIGH"))
        .when(http & (code >= 500), kind("HTTP_ERROR", "HIGH"))
        .when(http & (code >= 400), kind("HTTP_CLIENT_ERROR", "MEDIUM"))
        .when(http, kind("HTTP_SUCCESS", "LOW"))
        .otherwise(
            F.struct(event_type.alias("normalized_type"), F.lit("LOW").alias("severity"))
        )
    )


def latency_bucket(latency: Column) -> Column:
    """HIGH above 1000, MEDIUM above 200, else LOW; none when absent or zero."""
    return (
        F.when(latency.isNull() | (latency == 0), F.lit(None).cast("string"))
        .when(latency > 1000, "HIGH")
        .when(latency > 200, "MEDIUM")
        .otherwise("LOW")
    )


def error_severity(error: Column) -> Column:
    """Incident severity by the first listed text found in the error name."""
    name = F.lower(error)
    (text, severity), *rest = schema.ERROR_SEVERITY
    first = F.when(name.contains(text), severity)
    chain = reduce(lambda c, item: c.when(name.contains(item[0]), item[1]), rest, first)
    return chain.otherwise(schema.DEFAULT_ERROR_SEVERITY)


def severity_rank(severity: Column) -> Column:
    """LOW 1 ... CRITICAL 4, any letter case; null for anything else."""
    levels = F.array(*[F.lit(s) for s in schema.SEVERITIES])
    place = F.array_position(levels, F.upper(severity))
    return F.when(place > 0, place).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in schema.SEVERITIES]), rank)


def is_alert(severity: Column) -> Column:
    return F.upper(F.coalesce(severity, F.lit("LOW"))).isin(schema.ALERT_SEVERITIES)
