"""Stage tables fed by streaming queries.

Each stage reads the table before it as a stream and appends to its own. Ids
derive from the events and the file sink commits each micro-batch once, so a
restarted query neither loses nor repeats rows.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from vigilog.operators import anomaly, incidents, notify, parse, process, respond, rules
from vigilog.functions import fields
from vigilog.streaming import incremental, stateful

BACKFILL = {"availableNow": True}
EVERY_SECOND = {"processingTime": "1 second"}


def append(df: DataFrame, root: str, table: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to ``root/table``."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/{table}")
        .option("checkpointLocation", f"{root}/_checkpoints/{table}")
        .trigger(**(trigger or BACKFILL))
        .queryName(table)
        .start()
    )


END = datetime(2200, 1, 1, tzinfo=timezone.utc)  # pandas counts to 2262


def with_end_marks(rows: DataFrame, folder: str) -> DataFrame:
    """A stream with the rows of ``folder`` beside its own, for ``end_mark``."""
    spark, schema = rows.sparkSession, _nullable(rows.schema)
    # An empty table, so that the folder is there before the first mark.
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    return rows.unionByName(spark.readStream.schema(schema).parquet(folder))


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema])


def end_mark(spark: SparkSession, schema: StructType, folder: str, **values) -> None:
    """Tells a stream that no more rows come: one row of the far future that
    takes the watermark past all others, so that the next run gives out what is
    in state. ``values`` give it a key of its own and make it pass the filters
    before the watermark; it stays in state itself and is never given out.
    """
    row = tuple(values.get(f.name) for f in schema)
    spark.createDataFrame([row], _nullable(schema)).write.mode("append").parquet(folder)


def follow(spark: SparkSession, root: str, table: str, max_files: int | None = None) -> DataFrame:
    """A stage table as a stream, from its first row."""
    path = f"{root}/{table}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def ingest(lines: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Log lines to the raw table: decoded once, refused lines kept with reason.

    The open metadata object is stored as JSON text beside its typed fields.
    """
    rows = parse.parse_json_lines(lines).withColumn("metadata", F.to_json("metadata"))
    return append(rows, root, "raw_logs", trigger)


def process_raw(raw: DataFrame, root: str, trigger: dict | None = None) -> list[StreamingQuery]:
    done = raw.transform(parse.accepted).transform(process.process_logs)
    return [
        append(done, root, "processed_logs", trigger),
        append(parse.dead_letters(raw), root, "dead_letters", trigger),
    ]


def detect(
    logs: DataFrame,
    root: str,
    lateness: str,
    windowed: list[rules.WindowRule] | None = None,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """One query for the per-event rules, into ``signals_events``, and one for
    each windowed rule: a rule with a key counts in keyed state, into
    ``signals_<rule>``; one without a key would be a single state, so it runs as
    small batch jobs, into ``windows_<rule>/signals``."""
    windowed = rules.window_rules() if windowed is None else windowed
    queries = [append(emitted(rules.event_signals(logs)), root, "signals_events", trigger)]
    for rule in windowed:
        name = rule.signal_type.lower()
        if rule.key:
            found = stateful.window_signals(logs, rule, lateness)
            queries.append(append(emitted(found), root, f"signals_{name}", trigger))
        else:
            late = logs.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01' + INTERVAL {lateness})").first()[0]
            queries.append(incremental.window_signals(logs, rule, f"{root}/windows_{name}", late, trigger))
    return queries


def emitted(signals: DataFrame) -> DataFrame:
    """Stamp the time a signal left the pipeline, for latency figures."""
    return signals.withColumn("emitted_at", F.current_timestamp())


def open_incidents(signals: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    return append(incidents.create_incidents(signals), root, "incidents", trigger)


def plan_responses(
    opened: DataFrame, playbooks: DataFrame, root: str, trigger: dict | None = None
) -> StreamingQuery:
    """Stream to static join; the playbooks are read again for each micro-batch
    when they come from a file."""
    return append(respond.plan_responses(opened, playbooks), root, "responses", trigger)


def send_notifications(
    opened: DataFrame, channels: notify.Channels, root: str, trigger: dict | None = None
) -> StreamingQuery:
    rows = notify.fan_out(notify.from_incidents(opened), channels)
    return append(rows, root, "notifications", trigger)


def error_rates(logs: DataFrame, window: str, lateness: str) -> DataFrame:
    """Events and errors per service and closed window of a stream."""
    return (
        logs.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window), "service_name")
        .agg(F.count("*").alias("events"), F.count_if(anomaly.is_error()).alias("errors"))
        .select(
            "service_name", fields.micros(F.col("window.start")).alias("window_start_us"),
            "events", "errors",
        )
    )
