"""The given ``events`` table seen as canonical log rows.

A purely declarative mapping, so that a scan of ``events`` reads only the
columns a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilog.functions import fields


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table's times are UTC without a zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream."""
    known = read_events(spark, sf_dir).schema
    return (
        spark.readStream.schema(known)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def as_logs(events: DataFrame) -> DataFrame:
    """Canonical log columns with typed metadata."""
    number = F.get_json_object("props", "$.k").cast("int")
    events = events.select(
        "event_id", "ts", "user_id", "event_type", "value", fields.once(number).alias("k")
    )
    kind, value, k = F.col("event_type"), F.col("value"), F.col("k")
    http = kind.isin("error", "view", "click")
    login_failed = (kind == "signup") & (k % 5 < 3)
    deploy = (kind == "purchase") & (k % 10 == 0)
    query = (kind == "purchase") & (k % 10 != 0)
    status = F.when((kind == "error") & (k % 2 == 0), 500).when(kind == "error", 404)
    log_type = (
        F.when(http, "http.request")
        .when(login_failed, "auth.login_failed")
        .when(kind == "signup", "auth.login_success")
        .when(deploy, "deployment.failed")
        .when(query, "db.query")
    )
    service = (
        F.when(http, "api-gateway")
        .when(kind == "signup", "auth-service")
        .when(deploy, "deployment-service")
        .when(query, "db-monitor")
    )
    level = (
        F.when((kind == "error") & (k % 2 == 0), "ERROR")
        .when(login_failed, "WARN")
        .when(deploy, "ERROR")
        .otherwise("INFO")
    )
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        service.alias("service_name"),
        F.when(http, "application").when(kind == "signup", "security")
        .when(deploy, "deployment").when(query, "database").alias("category"),
        level.alias("log_level"),
        log_type.alias("event_type"),
        F.concat_ws(" ", log_type, F.concat(F.lit("k="), k)).alias("message"),
        F.concat(F.lit("trace-"), F.col("user_id")).alias("trace_id"),
        F.concat(F.lit("node-"), k % 3 + 1).alias("host"),
        F.lit("prod").alias("environment"),
        F.when(http, F.coalesce(status, F.lit(200))).cast("double").alias("status"),
        F.when(http | query, value * 20).alias("latency_ms"),
        F.when(http | (kind == "signup"),
               F.concat(F.lit("10.0.0."), F.col("user_id") % 255 + 1)).alias("client_ip"),
        F.when(http, F.concat(F.lit("/api/v1/r"), k % 3)).alias("path"),
        F.when(kind == "signup", F.concat(F.lit("user"), F.col("user_id"))).alias("username"),
        F.when(deploy, F.concat(F.lit("v0."), k % 5 + 1, F.lit("."), k)).alias("version"),
        F.when(deploy & (value > 50), "container_crash").alias("reason"),
    )


def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(read_events(spark, sf_dir))


def as_json_lines(logs: DataFrame) -> DataFrame:
    """Log rows as text lines, one JSON object each, the way services write them.

    Some lines are damaged, so that a parser has something to refuse: very
    slow requests are cut short, lines of one path are not objects, and so on.
    """
    metadata = F.struct(
        F.col("status").cast("int").alias("status"), "latency_ms", "client_ip", "path",
        "username", "version", "reason",
    )
    whole = F.to_json(
        F.struct(
            "event_id",
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            "service_name", "category", "log_level", "event_type", "message", "trace_id",
            "host", "environment", metadata.alias("metadata"),
        )
    )
    latency, text = F.col("latency_ms"), F.col("_whole")
    line = (
        F.when(latency > 5000, F.substring(text, 1, 60))
        .when(latency < 10, F.lit(""))
        .when(latency < 15, F.col("event_id"))
        .when(latency < 20, F.regexp_replace(text, '"event_id":"[^"]*",', ""))
        .when(latency < 25, F.regexp_replace(text, '"metadata":\\{[^}]*\\}', '"note":1'))
        .when(latency < 30, F.regexp_replace(text, '"latency_ms":[0-9.E]+', '"latency_ms":"slow"'))
        .otherwise(text)
    )
    return logs.withColumn("_whole", whole).select("event_id", line.alias("value"))


def as_text_lines(logs: DataFrame) -> DataFrame:
    """Log rows as free text: access lines for requests, service lines else."""
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    access = F.concat(
        "client_ip", F.lit(" - - ["), at, F.lit('] "GET '), "path", F.lit('" '),
        F.col("status").cast("int"), F.lit(" "), F.format_string("%.2f", "latency_ms"),
    )
    service = F.concat(
        at, F.lit(" "), "log_level", F.lit(" "), "service_name", F.lit(" ["), "event_type",
        F.lit("] "), "message", F.coalesce(F.concat(F.lit(" client_ip="), "client_ip"), F.lit("")),
        F.coalesce(F.concat(F.lit(" version="), "version"), F.lit("")),
    )
    return logs.select(
        "event_id",
        F.when(F.col("event_type") == "http.request", access)
        .when(F.col("event_type") == "auth.login_success", F.col("message"))
        .otherwise(service).alias("value"),
    )
