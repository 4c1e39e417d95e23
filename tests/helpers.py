"""Times and columns shared by the tests."""

from datetime import datetime, timedelta, timezone

START = datetime(2026, 3, 8, 16, 10, tzinfo=timezone.utc)

LOG_DDL = (
    "event_id string, timestamp timestamp, service_name string, log_level string, "
    "event_type string, message string, trace_id string, status double, latency_ms double, "
    "client_ip string, version string, reason string"
)


def at(seconds: float = 0) -> datetime:
    return START + timedelta(seconds=seconds)
