"""Lifecycle of incidents with deadlines: every update judged in order, overdue
incidents escalated.

An incident is in one state at a time, from its opening on. An update moves it if
the lifecycle allows the step; others leave it where it is, since when it was. A
state with a deadline that lasts longer than that ends by an escalation at the
deadline, and later updates are judged from there. So what an update does depends
on all before it.

Rows are range-partitioned by incident and time, so an incident of any number of
updates spreads over tasks. For each row a task works out, as if the row were taken,
which row is taken next and whether an escalation comes first; the rows taken are
then a chain. A task that begins inside an incident does not know the state there,
but all that can happen soon runs into one of few chains, and these few ends are
what it reports. A pass over the reports, one for each task, tells each task the
state that it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators.ordered import text_key
from vigilog.session import cut

ESCALATED = "escalated"
#: Later than all times.
_NEVER = np.iinfo(np.int64).max
_BY = ["_key", "_opens", "changed_at", "seq", "_copy"]


class Machine:
    """The states, the steps that are allowed, and how long (microseconds) a state
    may last."""

    def __init__(self, allowed: dict[str, list[str]] | None, deadlines_s: dict[str, float] | None):
        allowed = schema.LIFECYCLE if allowed is None else allowed
        self.states = sorted({*allowed, *(b for later in allowed.values() for b in later)})
        self.steps = {f"{a}>{b}" for a, later in allowed.items() for b in later}
        self.deadlines = {s: int(round(x * 1_000_000)) for s, x in (deadlines_s or {}).items()}
        for state, us in self.deadlines.items():
            if us <= 0 or f"{state}>{ESCALATED}" not in self.steps or state == ESCALATED:
                raise ValueError(f"no deadline can end {state!r} by an escalation")

    def verdict(self, previous: Column, status: Column) -> Column:
        """Of a row by the status of the row before it."""
        step = F.concat_ws(">", F.lower(previous), F.lower(status))
        return (
            F.when(previous.isNull(), "opened")
            .when(F.lower(previous) == F.lower(status), "unchanged")
            .when(step.isin(sorted(self.steps)), "valid")
            .otherwise("rejected")
        )


def notice(state: Column, opened: Column) -> Column:
    """What to tell about a state that has just been entered."""
    return F.when(opened, "created").when(state.isin("resolved", ESCALATED), state).otherwise("updated")


class _Part:
    """A task's sorted rows and the chains of rows that are taken."""

    def __init__(self, table: pa.Table, machine: Machine):
        self.table = table
        n = self.n = table.num_rows
        keys = table.column("_key").to_numpy(zero_copy_only=False)
        self.us = table.column("_us").to_numpy()
        self.cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, n]
        self.first_key, self.last_key = keys[0], keys[-1]
        self.run = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        self.end = self.cuts[self.run + 1]
        number = {s: i for i, s in enumerate(machine.states)}
        self.names = machine.states
        # Any other status is the last number; no step leads there or away.
        self.other, self.escalated = len(number), number.get(ESCALATED, -1)
        self.texts = table.column("_status").to_pylist()
        self.code = np.array([number.get(s, self.other) for s in self.texts], np.int64)
        self.lasts = np.full(self.other + 1, _NEVER)
        for state, us in machine.deadlines.items():
            self.lasts[number[state]] = us
        may = np.zeros((self.other + 1, self.other + 1), bool)
        for step in machine.steps:
            a, b = step.split(">")
            may[number[a], number[b]] = True
        # For each state and row the first row from there on that may be taken, in any run.
        self.later = np.full((self.other + 1, n + 1), n)
        for state in range(self.other):
            fits = np.where(may[state, self.code], np.arange(n), n)
            self.later[state, :n] = np.minimum.accumulate(fits[::-1])[::-1]

    def due(self, state: np.ndarray, since: np.ndarray) -> np.ndarray:
        lasts = self.lasts[state]
        return np.where(lasts == _NEVER, _NEVER, since + np.where(lasts == _NEVER, 0, lasts))

    def after(self, times: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The first row of each run that is later than the time."""
        run = np.r_[self.run, runs]
        order = np.lexsort((np.arange(len(run)) >= self.n, np.r_[self.us, times], run))
        before = np.cumsum(order < self.n)
        out = np.empty(len(run), np.int64)
        out[order] = before
        return out[self.n :]

    def leave(self, state, since, at, runs, ends):
        """From a state, looking at a run's rows from ``at`` on: the row taken next
        (-1: none) and the time of an escalation before it (never). ``ends`` is how
        long runs are known to last."""
        end = self.cuts[runs + 1]
        take = self.later[state, at]
        take = np.where(take < end, take, -1)
        due = self.due(state, since)
        until = np.where(take >= 0, self.us[take], ends)
        over = due < until
        late = np.maximum(self.after(np.where(over, due, 0), runs), at)
        instead = self.later[self.escalated, late] if self.escalated >= 0 else np.full(len(late), self.n)
        instead = np.where(instead < end, instead, -1)
        return np.where(over, instead, take), np.where(over, due, _NEVER)

    def chains(self, ends_of_runs: np.ndarray) -> None:
        """For each row, were it taken: the one taken next, an escalation before."""
        at = np.arange(self.n)
        self.next, self.over = self.leave(self.code, self.us, at + 1, self.run, ends_of_runs[self.run])

    def last_of(self, row: int) -> tuple[int, int]:
        """(state, since when) at the end of the chain of a row."""
        while self.next[row] >= 0:
            row = int(self.next[row])
        return self.state_of(row)

    def state_of(self, row: int) -> tuple[int, int]:
        if self.over[row] != _NEVER:
            return self.escalated, int(self.over[row])
        return int(self.code[row]), int(self.us[row])

    def ends_of(self, rows: list[int]) -> list[tuple[int, int]]:
        """``last_of`` of many rows, each chain walked once."""
        known: dict[int, tuple[int, int]] = {}
        for row in sorted(rows, reverse=True):
            path, at = [], row
            while at not in known and self.next[at] >= 0:
                path.append(at)
                at = int(self.next[at])
            end = known[at] if at in known else self.state_of(at)
            for seen in (*path, at):
                known[seen] = end
        return [known[row] for row in rows]


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    filled = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(filled) if filled else None


_REPORT = (
    "_task int, _from string, _to string, _one boolean, _raw string, _until bigint, _state int, _since bigint, "
    "_text string, _take array<struct<us:bigint,state:int,since:bigint>>, _late array<struct<us:bigint,state:int,since:bigint>>"
)


def _reports(machine: Machine):
    """Of each task its first and last key, and the state its last key is in at its
    end: ``_state`` and ``_since`` if the key begins in the task, else by the state
    it comes in with, ``_take`` (by state: the first row taken and what it leads to)
    and ``_late`` (the same for incidents escalated meanwhile, by time)."""

    def report(batches):
        table = _read(batches)
        if table is None:
            return
        part = _Part(table, machine)
        lo, hi = int(part.cuts[-2]), int(part.cuts[-1])
        ends = np.full(len(part.cuts) - 1, _NEVER)
        ends[-1] = part.us[hi - 1]
        part.chains(ends)
        state, since = part.last_of(lo)
        take, late = [], []
        if len(part.cuts) == 2:
            firsts = [int(x) if x < hi else -1 for x in part.later[: part.other, lo]]
            found = dict(zip([x for x in firsts if x >= 0], part.ends_of([x for x in firsts if x >= 0])))
            take = [None if x < 0 else {"us": int(part.us[x]), "state": found[x][0], "since": found[x][1]} for x in firsts]
            if machine.deadlines:
                # An incident that comes in was in its state before the first row.
                latest = part.us[lo] + max(machine.deadlines.values())
                stop = int(np.searchsorted(part.us[lo:hi], latest, "right")) + lo
                rows = np.unique(part.later[part.escalated, lo : min(stop + 1, hi)])
                rows = rows[rows < hi].tolist()
                for row, end in zip(rows, part.ends_of(rows)):
                    if late and (late[-1]["state"], late[-1]["since"]) == end:
                        late[-1]["us"] = int(part.us[row])
                    else:
                        late.append({"us": int(part.us[row]), "state": end[0], "since": end[1]})
        row = {
            "_task": TaskContext.get().partitionId(), "_from": part.first_key, "_to": part.last_key,
            "_one": len(part.cuts) == 2, "_raw": table.column("status")[hi - 1].as_py(),
            "_until": int(part.us[hi - 1]), "_state": state, "_since": since, "_text": part.texts[lo],
            "_take": take, "_late": late,
        }
        entry = pa.struct([("us", pa.int64()), ("state", pa.int32()), ("since", pa.int64())])
        kinds = {"_task": pa.int32(), "_state": pa.int32(), "_until": pa.int64(), "_since": pa.int64(),
                 "_one": pa.bool_(), "_take": pa.list_(entry), "_late": pa.list_(entry)}
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()], list(row))

    return report


def _entries(reports: list, machine: Machine) -> dict[int, tuple]:
    """By task: (state, since, text of a state that is none of the lifecycle's, status
    of the row before) its first key comes in with, or None; and whether its last key
    goes on in a later task."""
    rows = sorted(reports, key=lambda r: r["_task"])
    lasts = [machine.deadlines.get(s, _NEVER) for s in machine.states]
    escalated = machine.states.index(ESCALATED) if ESCALATED in machine.states else -1
    out: dict[int, tuple] = {}
    held = None
    for i, r in enumerate(rows):
        begun = i > 0 and rows[i - 1]["_to"] == r["_from"]
        entry = held if begun else None
        goes_on = i + 1 < len(rows) and rows[i + 1]["_from"] == r["_to"]
        out[r["_task"]] = entry, goes_on
        if not (begun and r["_one"]):
            held = r["_state"], r["_since"], r["_text"], r["_raw"]
            continue
        state, since, text, _ = entry
        if state < len(lasts):
            take = r["_take"][state]
            due = since + lasts[state] if lasts[state] != _NEVER else _NEVER
            if due < (take["us"] if take else r["_until"]):
                late = next((x for x in r["_late"] if x["us"] > due), None)
                state, since = (late["state"], late["since"]) if late else (escalated, due)
            elif take:
                state, since = take["state"], take["since"]
        held = state, since, text, r["_raw"]
    return out


def _walk(machine: Machine, entries: dict[int, tuple], until: int, names: list[str]):
    """Rows with the status before, the state after, and whether it is new; and the
    escalations."""

    def walk(batches):
        table = _read(batches)
        if table is None:
            return
        part = _Part(table, machine)
        entry, goes_on = entries[TaskContext.get().partitionId()]
        ends = np.full(len(part.cuts) - 1, until)
        if goes_on:
            ends[-1] = part.us[-1]
        part.chains(ends)
        starts = part.cuts[:-1].tolist()
        over: list[tuple[int, int, int]] = []  # row whose incident it is, state left, time
        head = None  # the state that the first run comes in with, its escalation
        if entry is not None:
            state, since, text, _ = entry
            at, due = part.leave(np.array([state]), np.array([since]), np.array([0]), np.array([0]), ends[:1])
            head = state, int(due[0])
            starts[0] = int(at[0])
            if due[0] != _NEVER:
                over.append((0, state, int(due[0])))
        taken = np.zeros(part.n, bool)
        front = np.array([s for s in starts if s >= 0], np.int64)
        while len(front) > 32:
            taken[front] = True
            front = part.next[front]
            front = front[front >= 0]
        for row in front.tolist():
            while row >= 0:
                taken[row] = True
                row = int(part.next[row])
        rows = np.flatnonzero(taken)
        rows = rows[part.over[rows] != _NEVER]
        over += list(zip(rows.tolist(), part.code[rows].tolist(), part.over[rows].tolist()))

        # The state after each row: that of the last row taken, unless escalated since.
        last = np.maximum.accumulate(np.where(taken, np.arange(part.n), -1))
        none = last < part.cuts[part.run]
        state = np.where(part.us > part.over[last], part.escalated, part.code[last])
        texts = [part.texts[k] if s == part.other else part.names[s] for k, s in zip(last.tolist(), state.tolist())]
        if none.any():
            first, due = head
            own = text if first == part.other else part.names[first]
            for k in np.flatnonzero(none).tolist():
                texts[k] = ESCALATED if part.us[k] > due else own
        raw = table.column("status")
        before = np.arange(part.n) - 1
        before[part.cuts[:-1]] = -1
        previous = raw.combine_chunks().take(pa.array(np.maximum(before, 0), mask=before < 0))
        if entry is not None:
            previous = pa.concat_arrays([pa.array([entry[3]], pa.string()), previous.slice(1)])
        yield pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks() for c in names), previous, pa.array(texts, pa.string()),
             pa.array(taken), pa.nulls(part.n, pa.int64())],
            [*names, "previous", "state", "_taken", "_overdue"])
        if over:
            of = pa.array([k for k, _, _ in over], pa.int64())
            n = len(over)
            left = [part.names[s] for _, s, _ in over]
            blank = {c: pa.nulls(n, table.schema.field(c).type) for c in names}
            blank["id"] = table.column("id").combine_chunks().take(of)
            blank["status"] = pa.array([ESCALATED] * n)
            yield pa.RecordBatch.from_arrays(
                [*(blank[c] for c in names), pa.array(left), pa.array([ESCALATED] * n), pa.array([True] * n),
                 pa.array([t for _, _, t in over], pa.int64())],
                [*names, "previous", "state", "_taken", "_overdue"])

    return walk


def judged(
    incidents: DataFrame,
    updates: DataFrame,
    allowed: dict[str, list[str]] | None = None,
    deadlines_s: dict[str, float] | None = None,
    until_us: int | None = None,
) -> DataFrame:
    """Every opening, update and escalation of the ``incidents``.

    ``previous`` and ``verdict`` (opened, unchanged, valid, rejected) are those of
    ``incidents.transitions``, by the row before; ``state`` is what the incident is
    in after the row, as in ``incidents.strict_state``; ``notice`` (created, updated,
    escalated, resolved) is there where the row has changed it. An escalation has the
    verdict ``overdue``, the time of the deadline and no ``seq``; ``previous`` is the
    state that lasted too long. ``deadlines_s`` gives seconds by state; ``until_us``
    is how far time has gone, to the end of all deadlines if not given. An update at
    the very deadline is in time. Updates before their incident's opening are taken
    right after it; those of unknown incidents are left out.
    """
    machine = Machine(allowed, deadlines_s)
    opened_us = fields.micros(F.col("created_at"))
    zero = F.lit(0).cast("bigint")
    opens = incidents.select(
        "id", "status", F.col("created_at").alias("changed_at"), F.lit(-1).cast("bigint").alias("seq"),
        F.lit(0).alias("_opens"), F.coalesce(opened_us, zero).alias("_us"))
    begun = incidents.groupBy("id").agg(F.min(opened_us).alias("_begun"))
    later = updates.join(begun, "id").select(
        "id", "status", "changed_at", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("_opens"),
        F.coalesce(F.greatest(fields.micros(F.col("changed_at")), "_begun"), zero).alias("_us"))
    rows = opens.unionByName(later).withColumns({
        "_key": text_key(["id"]), "_status": F.lower("status"), "_copy": F.monotonically_increasing_id()})
    placed = cut(rows.repartitionByRange(*_BY).sortWithinPartitions(*_BY))
    reports = placed.mapInArrow(_reports(machine), _REPORT).collect()  # one for each task
    out = ["id", "status", "changed_at", "seq"]
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in out)
    done = placed.mapInArrow(
        _walk(machine, _entries([r.asDict(True) for r in reports], machine), _NEVER if until_us is None else until_us, out),
        f"{kinds}, previous string, state string, _taken boolean, _overdue bigint")
    overdue = F.col("_overdue").isNotNull()
    verdict = F.when(overdue, "overdue").otherwise(machine.verdict(F.col("previous"), F.col("status")))
    return done.select(
        "id", "previous", "status",
        F.coalesce(F.timestamp_micros("_overdue"), "changed_at").alias("changed_at"), "seq",
        verdict.alias("verdict"), "state",
        F.when(F.col("_taken"), notice(F.col("state"), ~overdue & F.col("previous").isNull())).alias("notice"))


def escalated_when_overdue(steps: DataFrame) -> DataFrame:
    """The escalations among ``judged`` rows, as status updates."""
    return steps.filter("verdict = 'overdue'").select("id", "status", "changed_at", F.lit(0).cast("bigint").alias("seq"))
