"""Lifecycle of incidents on a stream: a state machine for each incident.

Openings and updates wait in state until the watermark has passed them, then they
are judged in time order, so that what comes late within the allowed lateness
changes nothing. Timers escalate an incident whose state has lasted longer than
its deadline. The rows are those of ``operators.lifecycle.judged``.

An update whose incident is not known waits for ``wait_s`` after its own time for
the opening and is then given out with the verdict ``unknown``; a row that comes
after the watermark has the verdict ``late`` and changes nothing. With ``keep_s`` an
incident that no step leads away from is forgotten that long after its last row;
without, its state, a few values, stays. One incident's open rows meet in one task.

Each call between Python and the state store takes far longer than a step does, so
incidents share the state of a bucket, dealt by a hash of the id: a bucket that has
something due is read, judged and written as a whole, in a number of calls that does
not depend on how many incidents are in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilog.functions import fields
from vigilog.operators.lifecycle import ESCALATED, Machine
from vigilog.streaming.stateful import use_rocksdb

_COLUMNS = ["id", "previous", "status", "us", "seq", "verdict", "state", "notice"]
_OUT = "id string, previous string, status string, us bigint, seq bigint, verdict string, state string, notice string"


def _lower(text: str | None) -> str | None:
    return None if text is None else text.lower()


class Lifecycle(StatefulProcessor):
    """The incidents of one bucket."""

    def __init__(self, machine: Machine, wait_us: int, keep_us: int | None):
        self.machine, self.wait_us, self.keep_us = machine, wait_us, keep_us
        self.final = {s for s in machine.states if not any(step.startswith(f"{s}>") for step in machine.steps)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, opens int, us bigint, seq bigint, status string")
        self.now = handle.getListState(
            "now", "id string, state string, since bigint, raw string, begun bigint, last bigint")
        self.done: dict[int, int] = {}  # by bucket, the watermark it has been judged up to

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        self.done.pop(key[0], None)
        late = []
        for pdf in rows:
            fresh = []
            for name, opens, us, seq, status in zip(*(pdf[c].tolist() for c in ("id", "opens", "us", "seq", "status"))):
                row = name, int(opens), int(us), int(seq), status
                if _passed(row[2], passed):
                    late.append((name, None, status, row[2], row[3], "late", None, None))
                else:
                    fresh.append(row)
            if fresh:
                self.waiting.appendList(fresh)
                self._wake_at(min(row[2] for row in fresh))
        return iter([_frame(late)] if late else [])

    def _wake_at(self, us: int) -> None:
        """Call back once the watermark has passed ``us``."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key[0]) == passed:
            return  # another timer of the bucket came first
        self.done[key[0]] = passed
        ready: dict[str, list[tuple]] = {}
        rest = []
        for row in self.waiting.get() if self.waiting.exists() else ():
            if _passed(row[2], passed):
                ready.setdefault(row[0], []).append(row)
            else:
                rest.append(row)
        before = {name: tuple(known) for name, *known in self.now.get()} if self.now.exists() else {}
        now = dict(before)
        out: list[tuple] = []
        for name, rows in ready.items():
            rows.sort(key=_order)
            known = now.get(name)
            if known is None and rows[0][1] != 0:
                # Not open yet: updates wait, but not for ever.
                for row in rows:
                    if _passed(row[2] + self.wait_us, passed):
                        out.append((name, None, row[4], row[2], row[3], "unknown", None, None))
                    else:
                        rest.append(row)
                continue
            for row in rows:
                known = self._judge(known, row, out)
            now[name] = known
        for name, known in now.items():
            now[name] = self._overdue(name, known, passed, out)
        self._keep(before, now, bool(ready), rest, passed)
        if out:
            yield _frame(out)

    def _judge(self, known: tuple | None, row: tuple, out: list[tuple]) -> tuple:
        name, _, at, seq, status = row
        to = _lower(status)
        if known is None:
            out.append((name, None, status, at, seq, "opened", to, "created"))
            return to, at, status, at, at
        state, since, raw, begun, _ = known
        us = max(at, begun)
        due = self._due(state, since)
        if due is not None and due < us:
            out.append((name, state, ESCALATED, due, None, "overdue", ESCALATED, ESCALATED))
            state, since = ESCALATED, due
        steps = self.machine.steps
        if raw is None:
            verdict = "opened"
        elif to is not None and raw.lower() == to:
            verdict = "unchanged"
        else:
            verdict = "valid" if f"{raw.lower()}>{to}" in steps else "rejected"
        told = None
        if f"{state}>{to}" in steps:
            state, since = to, us
            told = to if to in ("resolved", ESCALATED) else "updated"
        out.append((name, raw, status, at, seq, verdict, state, told))
        return state, since, status, begun, us

    def _due(self, state: str | None, since: int) -> int | None:
        lasts = self.machine.deadlines.get(state)
        return None if lasts is None else since + lasts

    def _overdue(self, name: str, known: tuple, passed: int, out: list[tuple]) -> tuple:
        state, since, *others = known
        due = self._due(state, since)
        if due is None or not _passed(due, passed):
            return known
        out.append((name, state, ESCALATED, due, None, "overdue", ESCALATED, ESCALATED))
        return (ESCALATED, due, *others)

    def _keep(self, before: dict[str, tuple], now: dict[str, tuple], judged: bool, rest: list[tuple], passed: int) -> None:
        """Store what has changed, and wake up when the next row or state of the
        bucket is due."""
        if judged:
            _put(self.waiting, rest)
        wakes = [us + self.wait_us if _passed(us, passed) else us for _, _, us, _, _ in rest]
        open_rows = {row[0] for row in rest}
        kept = {}
        for name, known in now.items():
            state, since, _, _, last = known
            if self.keep_us is not None and state in self.final and name not in open_rows:
                if _passed(last + self.keep_us, passed):
                    continue
                wakes.append(last + self.keep_us)
            due = self._due(state, since)
            if due is not None:
                wakes.append(due)
            kept[name] = known
        if kept != before:
            _put(self.now, [(name, *known) for name, known in kept.items()])
        if wakes:
            self._wake_at(min(wakes))

    def close(self) -> None:
        pass


def _passed(us: int, watermark_ms: int) -> bool:
    return us // 1000 + 1 <= watermark_ms


def _order(row: tuple) -> tuple:
    _, opens, us, seq, _ = row
    return opens, us, seq


def _frame(rows: list[tuple]) -> pd.DataFrame:
    # As objects: beside an escalation, which has no ``seq``, whole numbers would become floats.
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def changes(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Openings and updates as one stream; updates without a time have no place in it."""
    opened = incidents.select(
        "id", "status", F.col("created_at").alias("changed_at"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("opens"))
    later = updates.select(
        "id", "status", "changed_at", F.coalesce(F.col("seq").cast("bigint"), F.lit(0).cast("bigint")).alias("seq"),
        F.lit(1).alias("opens"))
    return opened.unionByName(later).filter("id is not null and changed_at is not null")


def judged(
    rows: DataFrame,
    lateness: str,
    allowed: dict[str, list[str]] | None = None,
    deadlines_s: dict[str, float] | None = None,
    wait_s: float = 86_400,
    keep_s: float | None = None,
    buckets: int = 4_096,
) -> DataFrame:
    """The steps of the incidents whose ``changes`` are a stream. ``buckets`` must stay
    the same while a checkpoint is used."""
    use_rocksdb(rows.sparkSession)
    machine = Machine(allowed, deadlines_s)
    keep_us = None if keep_s is None else int(keep_s * 1_000_000)
    # Without the event time itself in its input the operator sees late rows too.
    timed = rows.withWatermark("changed_at", lateness).select(
        F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"),
        "id", "opens", fields.micros(F.col("changed_at")).alias("us"), "seq", "status")
    found = timed.groupBy("bucket").transformWithStateInPandas(
        Lifecycle(machine, int(wait_s * 1_000_000), keep_us), _OUT, "Append", "EventTime")
    return found.withColumn("changed_at", F.timestamp_micros("us")).select(
        "id", "previous", "status", "changed_at", "seq", "verdict", "state", "notice")


def latest_state(steps: DataFrame) -> DataFrame:
    """(id, status, since) from the steps given out so far. An escalation goes before
    other rows of its very time, as those were judged after it."""
    known = steps.filter("state is not null")
    place = F.struct("changed_at", F.coalesce("seq", F.lit(-2).cast("bigint")))
    return known.groupBy("id").agg(F.max_by("state", place).alias("status"), F.max("changed_at").alias("changed_at"))
