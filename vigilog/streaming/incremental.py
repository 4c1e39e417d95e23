"""Windowed rules on a stream as small batch jobs over open rows.

Each micro-batch joins the new rows to the open ones, runs the batch operator
over everything the horizon has passed, and stores what stays open. Nothing is
gathered by key, so one key, or a rule without a key, spreads over all tasks.

A key's state needs no format of its own: after a firing, fewer than N later
rows can lie inside the window, and playing just these rows again leads to the
same state. So the open rows are the rows past the horizon plus, per key, the
rows after its last firing that are younger than the window.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.operators import rules, windows
from vigilog.session import cut


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def step(
    new: DataFrame,
    held: DataFrame | None,
    before_us: int | None,
    rule: rules.WindowRule,
    lateness_us: int,
) -> tuple[DataFrame, DataFrame, DataFrame, int | None]:
    """One micro-batch: (fired rows, open rows, late rows, new horizon).

    ``new`` are stored rows of ``rules.rule_matches``, ``held`` the open rows
    of the step before. Rows at or before the last horizon come too late and
    are returned apart.
    """
    late = new.filter(F.lit(False))
    if before_us is not None:
        late = new.filter(F.col("us") <= before_us)
        new = new.filter(F.col("us") > before_us)
    rows = new if held is None else held.unionByName(new)
    latest = new.agg(F.max("us")).first()[0]
    horizon = before_us
    if latest is not None:
        horizon = latest - lateness_us
        if before_us is not None:
            horizon = max(horizon, before_us)
    if horizon is None:
        return rows.filter(F.lit(False)), rows, late, horizon
    fired = windows.emit_and_reset(
        rows.filter(F.col("us") <= horizon), "run_key", "us", "event_id",
        rule.count, rule.window_us, stored=True,
    )
    last = fired.groupBy("run_key").agg(
        F.max(F.struct("us", "event_id")).alias("_last")
    )
    after = F.col("_last").isNull() | (F.struct("us", "event_id") > F.col("_last"))
    still = (
        rows.filter(F.col("us") >= horizon - rule.window_us)
        .join(last, "run_key", "left")
        .filter(after | (F.col("us") > horizon))
        .drop("_last")
    )
    return fired, still, late, horizon


def window_signals(
    logs: DataFrame,
    rule: rules.WindowRule,
    root: str,
    lateness_us: int,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that keeps ``root/signals`` up to date.

    Open rows and horizon alternate between two slots, so a micro-batch that
    is run again reads what the first try read and replaces what it wrote.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old, new = (batch_id - 1) % 2, batch_id % 2
        held = before = None
        if batch_id > 0:
            held = read_if_there(spark, f"{root}/open/slot={old}")
            mark = read_if_there(spark, f"{root}/horizon/slot={old}")
            before = mark.first()["us"] if mark is not None else None
        fired, still, late, horizon = step(cut(batch), held, before, rule, lateness_us)
        signals = rules.window_hits(fired, rule)
        signals.write.mode("overwrite").parquet(f"{root}/signals/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        still.write.mode("overwrite").parquet(f"{root}/open/slot={new}")
        spark.createDataFrame([(horizon, batch_id)], "us bigint, batch bigint").write.mode("overwrite").parquet(
            f"{root}/horizon/slot={new}"
        )

    return (
        rules.rule_matches(logs, rule)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def remaining_signals(spark: SparkSession, root: str, rule: rules.WindowRule) -> DataFrame | None:
    """Signals among the open rows, as if no more rows came; None before the
    first micro-batch. Changes nothing, so the stream may go on."""
    marks = []
    for slot in (0, 1):
        mark = read_if_there(spark, f"{root}/horizon/slot={slot}")
        if mark is not None:
            marks.append((mark.first()["batch"], slot))
    if not marks:
        return None
    rows = read_if_there(spark, f"{root}/open/slot={max(marks)[1]}")
    fired = windows.emit_and_reset(
        rows, "run_key", "us", "event_id", rule.count, rule.window_us, stored=True)
    return rules.window_hits(fired, rule)


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/signals").drop("batch")
