"""Validated, enriched, normalised events with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog import schema
from vigilog.functions import classify
from vigilog.operators import parse


def validate(parsed: DataFrame) -> DataFrame:
    """Keep the usable rows of ``parse.parse_json_lines``."""
    return parse.accepted(parsed)


def enrich(logs: DataFrame, region: str = schema.REGION, cluster: str = schema.CLUSTER) -> DataFrame:
    return logs.withColumns({"region": F.lit(region), "cluster": F.lit(cluster)})


def normalise(logs: DataFrame) -> DataFrame:
    kind = classify.normalised(F.col("event_type"), F.col("status"))
    return logs.withColumns(
        {"normalized_type": kind["normalized_type"], "severity": kind["severity"]}
    )


def extract_features(logs: DataFrame) -> DataFrame:
    return logs.withColumn(
        "features",
        F.struct(
            classify.latency_bucket(F.col("latency_ms")).alias("latency_bucket"),
            F.col("service_name").alias("service"),
        ),
    )


def process_logs(logs: DataFrame, steps=(enrich, normalise, extract_features)) -> DataFrame:
    """The chain over accepted rows; a step is any ``DataFrame -> DataFrame``."""
    for step in steps:
        logs = logs.transform(step)
    return logs


def process_lines(lines: DataFrame) -> DataFrame:
    return lines.transform(parse.parse_json_lines).transform(validate).transform(process_logs)


def classify_status(parsed: DataFrame, observation=None) -> DataFrame:
    """Mark each row ``processed`` or ``dropped``; counts go to ``observation``."""
    processed = F.col("reject_reason").isNull()
    marked = parsed.withColumn("_status", F.when(processed, "processed").otherwise("dropped"))
    if observation is None:
        return marked
    return marked.observe(
        observation,
        F.count_if(processed).alias("processed"),
        F.count_if(~processed).alias("dropped"),
    )


def raw_view(logs: DataFrame) -> DataFrame:
    return logs.select(
        "event_id", "service_name", "timestamp", "log_level", "event_type", "message",
        "metadata", "trace_id",
    )


def normalised_view(processed: DataFrame) -> DataFrame:
    return processed.select(
        "event_id", "service_name", "timestamp", "severity", "normalized_type", "metadata",
        "features",
    )
