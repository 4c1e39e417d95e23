"""Anomalies over windows of time, silent ones too, on a stream.

Counts of a service and window add up, so a micro-batch folds its events into the
windows that are open, the horizon being ``lateness_us`` behind the latest event. What
the horizon has passed is judged by ``anomaly.dense_anomalies`` over the kept windows,
the batch operator itself. Kept are the open windows and the ``history`` before them,
with each service's first window: services times windows, whatever the log volume. A
service that has been silent for longer is kept by its first window alone.

Below ``root``: ``scored``, all judged windows; ``late``, folded events of windows that
have been judged; and two slots in turn of the kept windows and the mark, so that a
micro-batch that is run again replaces what its first try wrote.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions import fields
from vigilog.operators import anomaly
from vigilog.session import cut
from vigilog.streaming.incremental import read_if_there

_KEPT = ["service_name", "window_start_us", "first_us", "events", "errors"]
_MARK = "edge bigint, latest bigint, batch bigint"


@dataclass(frozen=True)
class Watch:
    """What is judged: ``settings`` are those of ``anomaly.dense_anomalies``."""

    window_us: int
    lateness_us: int
    history: int = 24
    settings: dict = field(default_factory=dict)

    def scores(self, kept: DataFrame, until_us: int) -> DataFrame:
        # A service that is kept by its first window alone has no window here.
        rows = kept.filter("events > 0")
        return anomaly.dense_anomalies(rows, self.window_us, self.history, until_us=until_us, **self.settings)


def _mark(spark: SparkSession, root: str, before: int | None = None):
    """The mark of the last finished micro-batch (before one), or None."""
    found = []
    for slot in (0, 1):
        rows = read_if_there(spark, f"{root}/mark/slot={slot}")
        found += rows.collect() if rows is not None else []
    return max((r for r in found if before is None or r.batch < before), key=lambda r: r.batch, default=None)


def watch_batch(batch: DataFrame, number: int, root: str, watch: Watch) -> None:
    """Takes in micro-batch ``number``; may be run again until the next one has begun."""
    spark, slot, window_us = batch.sparkSession, number % 2, watch.window_us
    mark, start = _mark(spark, root, number), F.col("window_start_us")
    us = fields.micros(F.col("timestamp"))
    new = cut(
        batch.withColumn("_us", us).withColumn("window_start_us", fields.floor_to(F.col("_us"), window_us))
        .filter("_us IS NOT NULL").groupBy("service_name", "window_start_us")
        .agg(F.count("*").alias("events"), F.count_if(anomaly.is_error()).alias("errors"), F.max("_us").alias("_us")))
    latest = new.agg(F.max("_us")).first()[0]
    new = new.drop("_us").withColumn("first_us", start)
    before = None
    if mark is not None:
        before = mark.edge
        latest = max((t for t in (latest, mark.latest) if t is not None), default=None)
    edge = None if latest is None else (latest - watch.lateness_us) // window_us * window_us
    late = new.filter(F.lit(False)) if before is None else new.filter(start < before)
    late.drop("first_us").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
    rows = new if before is None else new.filter(start >= before)
    if mark is not None:
        rows = rows.unionByName(spark.read.parquet(f"{root}/kept/slot={1 - slot}"))
    folded = rows.groupBy("service_name", "window_start_us").agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.min("first_us").alias("first_us"))
    # The service's first window, whichever of its rows knows it.
    first = folded.groupBy("service_name").agg(F.min("first_us").alias("first_us"))
    folded = cut(
        folded.drop("first_us").alias("w").join(first.alias("f"), F.col("w.service_name").eqNullSafe(F.col("f.service_name")))
        .select("w.*", "first_us").select(*_KEPT))
    if edge is None:
        judged = watch.scores(folded, 0)
    else:
        judged = watch.scores(folded, edge)
        if before is not None:
            judged = judged.filter(start >= before)
    judged.write.mode("overwrite").parquet(f"{root}/scored/batch={number}")
    recent = folded.filter((F.col("events") > 0) & (start >= F.lit(0 if edge is None else edge - watch.history * window_us)))
    firsts = first.select(
        "service_name", F.col("first_us").alias("window_start_us"), "first_us", F.lit(0).cast("bigint").alias("events"),
        F.lit(0).cast("bigint").alias("errors"))
    recent.unionByName(firsts).write.mode("overwrite").parquet(f"{root}/kept/slot={slot}")
    spark.createDataFrame([(edge, latest, number)], _MARK).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/mark/slot={slot}")


def follow(logs: DataFrame, root: str, watch: Watch, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that judges the windows of a stream as they end."""
    root = root.rstrip("/")
    return (
        logs.writeStream.foreachBatch(lambda batch, number: watch_batch(batch, number, root, watch))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scored(spark: SparkSession, root: str) -> DataFrame:
    """The windows judged so far."""
    mark = _mark(spark, root.rstrip("/"))
    if mark is None:
        raise ValueError(f"no micro-batch has been finished below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/scored").filter(F.col("batch") <= mark.batch).drop("batch")


def remaining(spark: SparkSession, root: str, watch: Watch) -> DataFrame:
    """The open windows judged as if no more events came. Changes nothing."""
    root = root.rstrip("/")
    mark = _mark(spark, root)
    if mark is None:
        raise ValueError(f"no micro-batch has been finished below {root}")
    kept = spark.read.parquet(f"{root}/kept/slot={mark.batch % 2}")
    until = 0 if mark.latest is None else (mark.latest // watch.window_us + 1) * watch.window_us
    out = watch.scores(kept.groupBy("service_name", "window_start_us").agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.min("first_us").alias("first_us")), until)
    return out if mark.edge is None else out.filter(F.col("window_start_us") >= mark.edge)
