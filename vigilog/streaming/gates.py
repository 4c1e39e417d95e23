"""Gates of planned responses on a stream: cooldown, retry limit, known failures.

Attempts and the outcomes of earlier ones wait in state, by (service, action), until
the watermark has passed them, then they are judged in time order. The columns are
those of ``respond.gated``, with equal values.

What is kept of a service and action: the attempts of the retry window, counted per
time, which go when the window has left them; the last attempt (or the last allowed
one) while its cooldown lasts; the failures per error. A row that comes after the
watermark is given out with the decision ``late`` (attempts) or ``late_outcome`` and
counts for nothing. One service's open attempts of one action meet in one task.

That task's work grows with its rows, whatever the retry window holds: rows wait as
sorted runs of thousands, each one value in the state, and are judged by running sums
over some runs at a time. Calls to the state store grow with the runs, and memory with
the rows that lie in a piece of time of all runs, not with all that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilog.functions import fields
from vigilog.operators import respond
from vigilog.streaming.stateful import use_rocksdb

ATTEMPT, OUTCOME = 0, 1
_COLUMNS = ["service", "action", "incident_id", "error", "us", "attempts", "in_cooldown", "suppressed", "late"]
_OUT = (
    "service string, action string, incident_id string, error string, us bigint, attempts bigint, "
    "in_cooldown boolean, suppressed boolean, late string"
)
_WAITING = pa.schema([("kind", pa.int32()), ("us", pa.int64()), ("incident_id", pa.string()), ("error", pa.string())])
#: Rows of a value in the state, and rows that are read before some are stored or judged.
_RUN, _HELD = 10_000, 100_000
_NEVER = np.iinfo(np.int64).max


class Gates(StatefulProcessor):
    def __init__(self, cooldown_us: int, retry_window_us: int, failure_limit: int, after_allowed: bool):
        self.cooldown_us, self.retry_window_us = cooldown_us, retry_window_us
        self.failure_limit, self.after_allowed = failure_limit, after_allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us bigint, run bigint", "rows binary")
        self.runs = handle.getValueState("runs", "n bigint")
        self.recent = handle.getValueState("recent", "counts binary, last bigint")
        self.failures = handle.getMapState("failures", "error string", "n bigint, failed_us bigint")
        self.done: dict[tuple, int] = {}  # by key, the watermark it has been judged up to

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        self.done.pop(tuple(key), None)
        late, held = [], []
        for pdf in rows:
            came = pa.Table.from_pandas(pdf[_WAITING.names], _WAITING, preserve_index=False)
            is_late = _passed(_numbers(came, "us"), passed)
            if is_late.any():
                gone = came.filter(pa.array(is_late))
                late.append(_frame(key, gone, late=np.where(_numbers(gone, "kind") == ATTEMPT, "late", "late_outcome")))
            held.append(came.filter(pa.array(~is_late)))
            if sum(map(len, held)) >= _HELD:
                self._store(pa.concat_tables(held))
                held = []
        if held:
            self._store(pa.concat_tables(held))
        return iter(late)

    def _store(self, rows: pa.Table) -> None:
        if not len(rows):
            return
        rows = rows.sort_by("us")
        run = self.runs.get()[0] if self.runs.exists() else 0
        for lo in range(0, len(rows), _RUN):
            part = rows.slice(lo, _RUN)
            self.waiting.updateValue((part["us"][0].as_py(), run), (_pack(part),))
            run += 1
        self.runs.update((run,))
        self._wake_at(rows["us"][0].as_py())

    def _wake_at(self, us: int) -> None:
        """Call back once the watermark has passed ``us``."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        if self.done.get(tuple(key)) == passed:
            return  # another timer of the key came first
        self.done[tuple(key)] = passed
        counts, last = self.recent.get() if self.recent.exists() else (b"", None)
        recent = np.frombuffer(counts, "<i8").reshape(2, -1)
        failures = {k[0]: tuple(v) for k, v in self.failures.iterator()} if self.failures.exists() else {}
        before = dict(failures)
        for rows in self._ready(passed):
            kind = _numbers(rows, "kind")
            self._count_failures(rows.filter(pa.array(kind == OUTCOME)), failures)
            attempts = rows.filter(pa.array(kind == ATTEMPT))
            if len(attempts):
                found, recent, last = self._judge(key, attempts, recent, last, failures)
                yield found
        for error, known in failures.items():
            if before.get(error) != known:
                self.failures.updateValue((error,), known)
        self._keep(recent, last, passed)

    def _ready(self, passed: int) -> Iterator[pa.Table]:
        """Takes from the state what the watermark has passed, in time order, a piece of
        time in each table."""
        runs = sorted(tuple(k) for k in self.waiting.keys()) if self.waiting.exists() else []
        due = [run for run in runs if _passed(run[0], passed)]
        held, n = [], 0
        for place, run in enumerate(due, 1):
            held.append(_unpack(self.waiting.getValue(run)[0]))
            self.waiting.removeKey(run)
            n += len(held[-1])
            if n < _HELD and place < len(due):
                continue
            rows = pa.concat_tables(held)
            us = _numbers(rows, "us")
            # No run that is still to be read begins earlier.
            ready = us < due[place][0] if place < len(due) else _passed(us, passed)
            held, n = [rows.filter(pa.array(~ready))], 0
            if ready.any():
                yield rows.filter(pa.array(ready))
        if held:
            self._store(held[0])
        if len(due) < len(runs):
            self._wake_at(runs[len(due)][0])

    def _count_failures(self, outcomes: pa.Table, failures: dict) -> None:
        if not len(outcomes):
            return
        errors, names = _codes(outcomes)
        order = np.lexsort((_numbers(outcomes, "us"), errors))
        us, begins = _numbers(outcomes, "us")[order], np.searchsorted(errors[order], np.arange(len(names) + 1))
        for error, lo, hi in zip(names, begins, begins[1:]):
            n, failed_us = failures.get(error, (0, None))
            if failed_us is None:
                nth = max(self.failure_limit - n, 1)
                failed_us = int(us[lo + nth - 1]) if nth <= hi - lo else None
            failures[error] = n + int(hi - lo), failed_us

    def _judge(self, key, attempts: pa.Table, recent: np.ndarray, last: int | None, failures: dict) -> tuple:
        """Attempts after all of ``recent``, the times and numbers of earlier ones.
        Returns the rows, what is recent now and the time from which the cooldown runs."""
        by_incident = [("us", "ascending"), ("incident_id", "ascending")]
        attempts = attempts.take(pc.sort_indices(attempts, by_incident, null_placement="at_start"))
        us = _numbers(attempts, "us")
        times, first, n = np.unique(us, return_index=True, return_counts=True)
        recent = np.c_[recent, np.stack([times, n])]
        so_far = np.r_[0, np.cumsum(recent[1])]
        in_window = so_far[-len(times):] - so_far[np.searchsorted(recent[0], times - self.retry_window_us)]
        free, last = self._free(times, last)
        incident = _texts(attempts, "incident_id")
        errors, names = _codes(attempts)
        failed_us = [failures.get(error, (0, None))[1] for error in names]
        found = _frame(
            key, attempts, attempts=np.repeat(in_window, n),
            in_cooldown=~(np.repeat(free, n) & (incident == np.repeat(incident[first], n))),
            suppressed=us > np.array([_NEVER if t is None else t for t in failed_us])[errors])
        return found, recent[:, recent[0] >= times[-1] - self.retry_window_us], last

    def _free(self, times: np.ndarray, last: int | None) -> tuple[np.ndarray, int | None]:
        """Which of the times no cooldown holds back, and the time from which it runs after them."""
        free = np.zeros(len(times), bool)
        if not self.after_allowed:
            free[0] = last is None or times[0] - last >= self.cooldown_us
            free[1:] = np.diff(times) >= self.cooldown_us
            return free, int(times[-1])
        at = 0 if last is None else int(np.searchsorted(times, last + self.cooldown_us))
        while at < len(times):
            free[at] = True
            last = int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.cooldown_us)))
        return free, last

    def _keep(self, recent: np.ndarray, last: int | None, passed: int) -> None:
        floor = passed * 1000
        recent = recent[:, recent[0] + self.retry_window_us >= floor - 1000]
        if last is not None and last + self.cooldown_us < floor - 1000:
            last = None
        # Look again when all that is kept for a time may go.
        ends = [int(t) + self.retry_window_us for t in recent[0][-1:]] + ([] if last is None else [last + self.cooldown_us])
        if ends:
            self.recent.update((recent.astype("<i8").tobytes(), last))
            self._wake_at(max(ends) + 2000)
        else:
            self.recent.clear()

    def close(self) -> None:
        pass


def _passed(us, watermark_ms: int):
    return us // 1000 + 1 <= watermark_ms


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_numpy()


def _texts(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].to_pandas().to_numpy(object)


def _codes(rows: pa.Table) -> tuple[np.ndarray, list]:
    """The errors as numbers, and what they stand for."""
    coded = rows["error"].combine_chunks().dictionary_encode("encode")
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _pack(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpack(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(rows))).read_all()


def _frame(key, rows: pa.Table, **found: np.ndarray) -> pd.DataFrame:
    known = {"service": key[0], "action": key[1], "us": _numbers(rows, "us")}
    known |= {c: _texts(rows, c) for c in ("incident_id", "error")}
    frame = pd.DataFrame({**dict.fromkeys(_COLUMNS), **known, **found}, columns=_COLUMNS)
    return frame.astype({"attempts": "Int64", "in_cooldown": "boolean", "suppressed": "boolean"})


def attempts_and_outcomes(responses: DataFrame, history: DataFrame) -> DataFrame:
    """Planned responses and failed ones as one stream; rows without a time have no
    place in it."""
    planned = responses.filter("status <> 'no_playbook'").select(
        "service", "action", F.lit(ATTEMPT).alias("kind"), "incident_id", "error", F.col("created_at").alias("at"))
    failed = history.filter("status = 'failed'").select(
        "service", "action", F.lit(OUTCOME).alias("kind"), "incident_id", "error", F.col("executed_at").alias("at"))
    return planned.unionByName(failed).filter("at is not null")


def gated(
    rows: DataFrame,
    lateness: str,
    cooldown_us: int,
    retry_limit: int,
    retry_window_us: int,
    failure_limit: int = 1,
    protected: DataFrame | None = None,
    cooldown_after: str = "attempt",
) -> DataFrame:
    """The decisions about the attempts in a stream of ``attempts_and_outcomes``."""
    use_rocksdb(rows.sparkSession)
    gates = Gates(cooldown_us, retry_window_us, failure_limit, cooldown_after == "allowed")
    # Without the event time itself in its input the operator sees late rows too.
    timed = rows.withWatermark("at", lateness).select(
        "service", "action", "kind", fields.micros(F.col("at")).alias("us"), "incident_id", "error")
    found = timed.groupBy("service", "action").transformWithStateInPandas(gates, _OUT, "Append", "EventTime")
    decided = respond.with_decision(found, retry_limit, protected)
    return decided.withColumn("decision", F.coalesce("late", "decision")).drop("late")
