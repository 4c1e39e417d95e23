"""Names, types and fixed values of the log-to-incident data model."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Results depend on these exact names and constants.
# ---------------------------------------------------------------------------

# Keys a log event must carry (a JSON null counts as present).
REQUIRED_FIELDS = ["event_id", "service_name", "timestamp", "log_level", "event_type"]

# Top-level keys of a log event other than the open metadata object.
TEXT_FIELDS = [
    "event_id", "timestamp", "service_name", "category", "log_level", "event_type",
    "message", "trace_id", "span_id", "host", "container_id", "environment",
    "schema_version",
]

# Metadata keys read by some operator, with the type they are read as.
METADATA_FIELDS = {
    "status": "double",
    "latency_ms": "double",
    "client_ip": "string",
    "username": "string",
    "path": "string",
    "version": "string",
    "reason": "string",
    "cpu_percent": "double",
    "memory_used_mb": "double",
}

REGION = "us-east-1"
CLUSTER = "prod-cluster"

LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL", "ALERT"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_SEVERITIES = ["CRITICAL", "HIGH"]
SERVICES = ["api-gateway", "auth-service", "db-monitor", "deployment-service", "k8s-runtime"]
SIGNAL_TYPES = [
    "HTTP_ERROR_SPIKE", "HIGH_LATENCY", "BRUTE_FORCE_LOGIN", "DEPLOYMENT_FAILURE",
    "DB_SLOW_QUERY",
]

HIGH_LATENCY_MS = 2000
SLOW_QUERY_MS = 3000
LOGIN_FAILURES, LOGIN_WINDOW_S = 5, 60
HTTP_ERRORS, HTTP_WINDOW_S = 10, 30

# Incident severity by the first text found in the error name.
ERROR_SEVERITY = [
    ("database", "critical"),
    ("timeout", "high"),
    ("connection", "high"),
    ("error", "medium"),
]
DEFAULT_ERROR_SEVERITY = "low"

PLAYBOOKS = {
    "DB_SLOW_QUERY": "restart_database",
    "HTTP_ERROR_RATE": "restart_http_service",
    "AUTH_FAILURE_SPIKE": "lock_accounts",
}

# Lifecycle: the documented order, with investigation, mitigation and
# escalation states beside it.
LIFECYCLE = {
    "open": ["in_progress", "investigating", "escalated", "resolved"],
    "in_progress": ["mitigating", "escalated", "resolved"],
    "investigating": ["in_progress", "mitigating", "escalated", "resolved"],
    "mitigating": ["investigating", "escalated", "resolved"],
    "escalated": ["investigating", "mitigating", "resolved"],
    "resolved": [],
}

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


METADATA_MAP = T.MapType(T.StringType(), T.StringType())

SIGNAL_SCHEMA = T.StructType(
    _strings("signal_id", "signal_type", "severity", "service")
    + [
        T.StructField("metadata", METADATA_MAP),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("rule_order", T.IntegerType()),
    ]
)

INCIDENT_SCHEMA = T.StructType(
    _strings("id", "service", "error", "severity", "status")
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("signal_id", T.StringType()),
        T.StructField("signal_severity", T.StringType()),
        T.StructField("evidence", METADATA_MAP),
    ]
)

PLAYBOOK_SCHEMA = T.StructType(_strings("signal_type", "action"))

STEP_TYPE = T.StructType(
    [T.StructField("step_order", T.IntegerType())]
    + _strings("action_type", "target_service", "command")
    + [T.StructField("retry_count", T.IntegerType())]
)

STEP_PLAYBOOK_SCHEMA = T.StructType(
    _strings("playbook_id", "name", "trigger_signal")
    + [
        T.StructField("requires_approval", T.BooleanType()),
        T.StructField("steps", T.ArrayType(STEP_TYPE)),
    ]
)

RULE_SCHEMA = T.StructType(
    _strings("rule_id")
    + [
        T.StructField("version", T.IntegerType()),
        T.StructField("valid_from", T.TimestampType()),
    ]
    + _strings("event_type", "field", "op")
    + [T.StructField("threshold", T.DoubleType())]
    + _strings("signal_type", "severity")
    + [
        T.StructField("window_s", T.IntegerType()),
        T.StructField("count", T.IntegerType()),
    ]
    + _strings("key_field", "threshold_text")
)
