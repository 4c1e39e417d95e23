"""Query and replay over stored logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F


def search_logs(
    logs: DataFrame,
    service: str | None = None,
    level: str | None = None,
    event_type: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    contains: str | None = None,
) -> DataFrame:
    """Rows that meet every given condition; ``until`` is exclusive.

    Plain predicates on stored columns, so they reach the Parquet scan, and
    the date partitions when the table is written by ``tables.write_by_day``.
    """
    out = logs
    for column, wanted in (
        ("service_name", service), ("log_level", level), ("event_type", event_type)
    ):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    if since is not None:
        out = out.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
        if "day" in logs.columns:
            out = out.filter(F.col("day") >= F.lit(since).cast("timestamp").cast("date"))
    if until is not None:
        out = out.filter(F.col("timestamp") < F.lit(until).cast("timestamp"))
        if "day" in logs.columns:
            out = out.filter(F.col("day") <= F.lit(until).cast("timestamp").cast("date"))
    if contains is not None:
        out = out.filter(F.lower("message").contains(contains.lower()))
    return out


def replay(logs: DataFrame, since: datetime | str, until: datetime | str, transform) -> DataFrame:
    """Run a transform again over a time range of stored logs.

    Ids derive from the events, so replayed rows equal the first run's.
    """
    return search_logs(logs, since=since, until=until).transform(transform)
