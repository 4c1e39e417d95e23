"""Windowed rules on a stream with keyed state.

Rows wait in state until the watermark has passed them and are then counted in
time order, so the result equals the batch operator's for all rows that come
within the allowed lateness. One key's rows meet in one task; for keys that
may hold a large share of a stream, or rules without a key, use
``incremental.window_signals``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilog.operators import rules, windows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "run_key string, us bigint, event_id string, service_name string"


class CountAndReset(StatefulProcessor):
    """Fires on the n-th row inside the window, then counts afresh."""

    def __init__(self, n: int, window_us: int):
        self.n, self.window_us = n, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", "us bigint, event_id string, service_name string"
        )
        self.usable = handle.getListState("usable", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for pdf in rows:
            fresh = list(
                zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["service_name"].tolist())
            )
            self.waiting.appendList(fresh)
            self._wake_at(min(us for us, _, _ in fresh))
        return iter(())

    def _wake_at(self, us: int) -> None:
        """Call back once the watermark has passed ``us``."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [row for row in waiting if row[0] // 1000 + 1 <= now]
        usable = [row[0] for row in self.usable.get()] if self.usable.exists() else []
        fired = []
        for us, event_id, service in ready:
            usable = (usable + [us])[-self.n:]
            if len(usable) == self.n and us - usable[0] <= self.window_us:
                fired.append((key[0], us, event_id, service))
                usable = []
        if ready:
            rest = waiting[len(ready):]
            self._keep(self.waiting, rest)
            if rest:
                self._wake_at(rest[0][0])
            if usable:
                # Look again when the last usable row has left the window.
                self._wake_at(usable[-1] + self.window_us)
        floor = now * 1000 - self.window_us
        self._keep(self.usable, [(us,) for us in usable[-(self.n - 1):] if us >= floor]
                   if self.n > 1 else [])
        if fired:
            yield pd.DataFrame(fired, columns=["run_key", "us", "event_id", "service_name"])

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def window_signals(logs: DataFrame, rule: rules.WindowRule, lateness: str) -> DataFrame:
    """Signals of one windowed rule on a stream of log rows."""
    use_rocksdb(logs.sparkSession)
    counted = rules.rule_matches(logs, rule).withWatermark("timestamp", lateness)
    fired = (
        counted.select("run_key", "us", "event_id", "service_name", "timestamp")
        .groupBy("run_key")
        .transformWithStateInPandas(
            CountAndReset(rule.count, rule.window_us), _OUT, "Append", "EventTime"
        )
    )
    # The key's columns again, for the evidence.
    parts = windows.key_parts(F.col("run_key"), rule.key)
    keys = {c: part for c, part in parts.items() if c != "service_name"}
    return rules.window_hits(
        fired.withColumns({"timestamp": F.timestamp_micros("us"), **keys}), rule
    )
