"""Incidents to planned responses, with safety gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog.functions import classify, fields
from vigilog.operators.asof import asof_join
from vigilog.operators.ordered import join_keys, with_running_sum
from vigilog.operators.windows import run_key, sliding_count
from vigilog.session import cut, dimension, is_small


def plan_responses(incidents: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Each incident's action by exact match of its error; ``none`` without a
    playbook. A small playbook table is broadcast, so incidents stay where
    they are; a larger one is joined with hot errors split by the planner."""
    found = dimension(playbooks.select(F.col("signal_type").alias("error"), "action"))
    action = F.col("action")
    context = [c for c in ("service", "error", "severity", "created_at", "evidence")
               if c in incidents.columns]
    return incidents.join(found, "error", "left").select(
        F.col("id").alias("incident_id"),
        F.coalesce(action, F.lit("none")).alias("action"),
        F.when(action.isNull(), "no_playbook").otherwise("success").alias("status"),
        *context,
    )


def playbook_coverage(signals: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Signal types without a playbook and playbooks without a signal."""
    seen = signals.groupBy("signal_type").agg(F.count("*").alias("signals"))
    known = playbooks.select("signal_type", "action")
    return (
        seen.join(known, "signal_type", "full")
        .withColumn(
            "coverage",
            F.when(F.col("action").isNull(), "no_playbook")
            .when(F.col("signals").isNull(), "never_signalled")
            .otherwise("covered"),
        )
        .withColumn("signals", F.coalesce("signals", F.lit(0)))
    )


def action_plan(incidents: DataFrame, playbooks: DataFrame) -> DataFrame:
    """One row per incident and playbook step, in step order."""
    steps = playbooks.select(
        "playbook_id", F.col("trigger_signal").alias("error"), "requires_approval",
        F.explode("steps").alias("step"),
    )
    return incidents.join(dimension(steps), "error").select(
        F.col("id").alias("incident_id"),
        "playbook_id",
        "requires_approval",
        "step.step_order",
        "step.action_type",
        # A step without a target acts on the incident's own service.
        F.coalesce("step.target_service", "service").alias("target_service"),
        "step.command",
        "step.retry_count",
    )


def select_playbooks(playbooks: DataFrame, history: DataFrame) -> DataFrame:
    """The best playbook for every (signal type, severity).

    ``playbooks`` has ``playbook_id, trigger_signal, min_severity,
    max_severity, priority, action``; ``history`` has past ``error, action,
    status``. Highest priority wins, then the better success rate, then the
    name. Worked out on the small side, so that incidents need no window.
    """
    rate = history.groupBy(F.col("error").alias("trigger_signal"), "action").agg(
        F.round(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)), 6)
        .alias("success_rate")
    )
    low = classify.severity_rank(F.col("min_severity"))
    high = classify.severity_rank(F.col("max_severity"))
    per_level = playbooks.withColumn("rank", F.explode(F.sequence(low, high)))
    scored = per_level.join(rate, ["trigger_signal", "action"], "left").withColumn(
        "success_rate", F.coalesce("success_rate", F.lit(0.0))
    )
    best = Window.partitionBy("trigger_signal", "rank").orderBy(
        F.desc("priority"), F.desc("success_rate"), "playbook_id"
    )
    chosen = (
        scored.withColumn("_place", F.row_number().over(best))
        .filter("_place = 1")
        .select("trigger_signal", "rank", "playbook_id", "action", "priority", "success_rate")
    )
    # At most one row per playbook and severity.
    return F.broadcast(chosen) if is_small(playbooks) else chosen


def match_playbooks(incidents: DataFrame, best: DataFrame) -> DataFrame:
    """Incidents with the playbook chosen by ``select_playbooks``."""
    rank = classify.severity_rank(F.col("severity"))
    chosen = best.withColumnRenamed("trigger_signal", "error")
    return incidents.withColumn("rank", rank).join(chosen, ["error", "rank"], "left").select(
        F.col("id").alias("incident_id"), "error", "severity", "playbook_id", "action",
        "priority", "success_rate",
    )


def success_so_far(history: DataFrame) -> DataFrame:
    """(error, action, us, tried, succeeded): outcomes known at each time at which
    there are new ones. Outcomes of one time are folded first, then summed in
    order, so a pattern of any size spreads over tasks."""
    moments = history.filter(F.col("executed_at").isNotNull()).groupBy(
        "error", "action", fields.micros(F.col("executed_at")).alias("us")
    ).agg(F.count("*").alias("_n"), F.count_if(F.col("status") == "success").alias("_ok"))
    keys = ["error", "action"]
    tried = with_running_sum(moments, keys, ["us"], "_n", "tried")
    return with_running_sum(tried, keys, ["us"], "_ok", "succeeded").drop("_n", "_ok")


def choose_playbooks_as_of(incidents: DataFrame, playbooks: DataFrame, history: DataFrame) -> DataFrame:
    """Incidents with the playbook that looked best at their time: highest priority
    first, then the better success rate of its action for the error among outcomes
    known by then, then the name. What came out later changes nothing.

    ``playbooks`` and ``history`` are those of ``select_playbooks``, the latter with
    ``executed_at``. Playbooks that another one of higher priority beats are left
    out beforehand, so an incident has as many candidates as share the highest
    priority; each gets its success rate by an as-of join. Incidents without a
    candidate have null there.
    """
    low = classify.severity_rank(F.col("min_severity"))
    high = classify.severity_rank(F.col("max_severity"))
    per_level = playbooks.select(
        F.col("trigger_signal").alias("error"), F.explode(F.sequence(low, high)).alias("rank"),
        "playbook_id", "action", "priority")
    first = Window.partitionBy("error", "rank").orderBy(F.desc("priority"))
    likely = per_level.withColumn("_place", F.rank().over(first)).filter("_place = 1").drop("_place")
    opened = incidents.select(
        F.col("id").alias("incident_id"), "error", "severity", fields.micros(F.col("created_at")).alias("us"),
    ).withColumn("rank", classify.severity_rank(F.col("severity")))
    pairs = opened.join(dimension(likely), ["error", "rank"], "left")
    known = asof_join(pairs, success_so_far(history), ["error", "action"], "us", "us", ["tried", "succeeded"])
    rate = F.round(F.coalesce(F.col("succeeded") / F.col("tried"), F.lit(0.0)), 6)
    best = F.min(F.struct(
        (-rate).alias("_rate"), "playbook_id", "action", "priority",
        F.coalesce("tried", F.lit(0)).alias("tried")))
    chosen = known.groupBy("incident_id", "error", "severity", "us").agg(best.alias("_b"))
    book = F.col("_b.playbook_id")
    return chosen.select(
        "incident_id", "error", "severity", book.alias("playbook_id"), F.col("_b.action").alias("action"),
        F.col("_b.priority").alias("priority"),
        F.when(book.isNotNull(), F.abs(F.col("_b._rate"))).alias("success_rate"),
        F.when(book.isNotNull(), F.col("_b.tried")).alias("tried"))


def in_cooldown(
    attempts: DataFrame, keys: list[str], us: str, order: str, cooldown_us: int
) -> DataFrame:
    """Mark attempts that follow another one of the same key within less than
    ``cooldown_us``; held-back attempts count as attempts too.

    Attempts are folded into slots of the cooldown length before the shuffle:
    only the first attempt of a slot can be free, and only if the last one of
    the slot before is long enough ago. So a key's window has one row per
    slot, not per attempt.
    """
    slot = fields.floor_to(F.col(us), cooldown_us)
    rows = attempts.withColumn("_slot", slot)
    slots = rows.groupBy(*keys, "_slot").agg(
        F.min(F.struct(us, order)).alias("_first"), F.max(us).alias("_last")
    )
    in_order = Window.partitionBy(*keys).orderBy("_slot")
    before = F.lag("_last").over(in_order)
    free = before.isNull() | (F.col("_first")[us] - before >= cooldown_us)
    marks = slots.withColumn("_free", free).drop("_last")
    is_first = F.struct(us, order) == F.col("_first")
    return (
        join_keys(rows, marks, [*keys, "_slot"], "inner")
        .withColumn("in_cooldown", ~(is_first & F.col("_free")))
        .drop("_slot", "_first", "_free")
    )


class _Times:
    """The sorted times of a task by key: (key, first row, end row)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], gap: int):
        self.gap, self.runs = gap, []
        filled = [batch for batch in batches if batch.num_rows]
        if not filled:
            return
        self.table = pa.Table.from_batches(filled)
        keys = self.table.column("_key").to_numpy(zero_copy_only=False)
        self.us = self.table.column("_us").to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        self.runs = [(keys[lo], lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(keys)])]

    def following(self, lo: int, hi: int) -> np.ndarray:
        """For each row of a run the next one that is ``gap`` later, or the end."""
        part = self.us[lo:hi]
        return lo + np.searchsorted(part, part + self.gap)

    def ends(self, lo: int, hi: int) -> np.ndarray:
        """For each row the last pick if it is picked, by doubling the steps."""
        at = self.following(lo, hi)
        at = np.where(at == hi, np.arange(lo, hi), at) - lo
        while True:
            further = at[at]
            if np.array_equal(further, at):
                return self.us[lo:hi][at]
            at = further


def _reports(gap: int):
    """Of each task: its first and last key, and when the last key is free again
    for each time that it may be free from."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = _Times(batches, gap)
        if not times.runs:
            return
        key, lo, hi = times.runs[-1]
        ends = times.ends(lo, hi)
        # A key that comes from an earlier task is free within a gap of its first row.
        # So its picks begin at one of the rows till then or at the one after.
        starts = 1 if len(times.runs) > 1 else min(hi - lo, int(np.searchsorted(times.us[lo:hi], times.us[lo] + gap)) + 1)
        last = np.r_[np.flatnonzero(np.diff(ends[:starts])), starts - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([times.runs[0][0]]), pa.array([key]),
             pa.array([len(times.runs) == 1]), pa.array([times.us[lo:hi][last]], pa.list_(pa.int64())),
             pa.array([ends[last] + gap], pa.list_(pa.int64()))],
            ["_task", "_from", "_to", "_one", "_until", "_free"])

    return report


def _entries(reports: list) -> dict[int, int]:
    """When the first key of each task is free, where an earlier task has it."""
    out: dict[int, int] = {}
    key, free = None, 0
    for r in sorted(reports, key=lambda r: r["_task"]):
        begun = r["_from"] == key
        if begun:
            out[r["_task"]] = free
        if not (r["_one"] and begun):
            free = r["_free"][0]
        else:
            at = int(np.searchsorted(r["_until"], free))
            free = r["_free"][at] if at < len(r["_free"]) else free
        key = r["_to"]
    return out


def _picks(gap: int, entries: dict[int, int]):
    """The first row of each key, then each next one at least ``gap`` later."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = _Times(batches, gap)
        entry = entries.get(TaskContext.get().partitionId())
        chosen = []
        for place, (_, lo, hi) in enumerate(times.runs):
            after = times.following(lo, hi)
            at = lo if place or entry is None else lo + int(np.searchsorted(times.us[lo:hi], entry))
            while at < hi:
                chosen.append(at)
                at = int(after[at - lo])
        if chosen:
            yield from times.table.take(pa.array(chosen, pa.int64())).to_batches()

    return pick


def in_cooldown_of_allowed(
    attempts: DataFrame, keys: list[str], us: str, order: str, cooldown_us: int
) -> DataFrame:
    """Mark attempts that follow the last *allowed* one of the same key within
    less than ``cooldown_us``; held-back attempts do not count.

    Which attempts are allowed depends on all before. Attempts are folded per
    time, then range-partitioned by key and time, so a key of any size spreads
    over tasks. A task that begins inside a key plays its picks from every time
    the key may be free at its first rows (they soon coincide) and reports when
    the key is free again; a pass over these reports, one for each task, tells
    each task where its picks begin.
    """
    if cooldown_us <= 0:
        raise ValueError("the cooldown must be longer than 0 microseconds")
    rows = attempts.withColumns({"_key": run_key(keys), "_us": F.col(us)})
    times = rows.groupBy("_key", "_us").agg(F.min(order).alias("_first"))
    placed = cut(times.repartitionByRange("_key", "_us").sortWithinPartitions("_key", "_us"))
    reports = placed.mapInArrow(
        _reports(cooldown_us),
        "_task int, _from string, _to string, _one boolean, _until array<bigint>, _free array<bigint>",
    ).collect()
    picked = placed.mapInArrow(_picks(cooldown_us, _entries(reports)), placed.schema)
    marked = rows.join(picked.withColumn("_free", F.lit(True)), ["_key", "_us"], "left")
    allowed = F.col("_free") & (F.col(order) == F.col("_first"))
    return marked.withColumn(
        "in_cooldown", ~F.coalesce(allowed, F.lit(False))
    ).drop("_key", "_us", "_first", "_free")


def safety_gate(
    responses: DataFrame,
    cooldown_us: int,
    retry_limit: int,
    retry_window_us: int,
    protected: DataFrame | None = None,
    cooldown_after: str = "attempt",
) -> DataFrame:
    """Allow or hold back each planned action.

    In order: services in ``protected(service)`` are left alone; more than
    ``retry_limit`` attempts of the same action on a service within the window
    are refused; so are attempts within the cooldown, which runs from the last
    attempt or, with ``cooldown_after="allowed"``, from the last attempt the
    cooldown let pass.
    """
    keys = ["service", "action"]
    attempts = responses.filter("status <> 'no_playbook'").withColumn(
        "us", fields.micros(F.col("created_at"))
    )
    if cooldown_after == "allowed":
        gated = in_cooldown_of_allowed(attempts, keys, "us", "incident_id", cooldown_us)
    else:
        gated = in_cooldown(attempts, keys, "us", "incident_id", cooldown_us)
    return with_decision(sliding_count(gated, keys, "us", retry_window_us, "attempts"), retry_limit, protected)


def with_decision(gated: DataFrame, retry_limit: int, protected: DataFrame | None) -> DataFrame:
    """The decision by ``service``, ``attempts`` and ``in_cooldown``."""
    is_protected: Column = F.lit(False)
    if protected is not None:
        marked = protected.select("service").distinct().withColumn("_protected", F.lit(True))
        gated = gated.join(dimension(marked), "service", "left")
        is_protected = F.coalesce("_protected", F.lit(False))
    return gated.withColumn(
        "decision",
        F.when(is_protected, "protected")
        .when(F.col("attempts") > retry_limit, "retry_limit")
        .when(F.col("in_cooldown"), "cooldown")
        .otherwise("allowed"),
    ).drop("_protected")


def gated(
    responses: DataFrame,
    history: DataFrame,
    cooldown_us: int,
    retry_limit: int,
    retry_window_us: int,
    failure_limit: int = 1,
    protected: DataFrame | None = None,
    cooldown_after: str = "attempt",
) -> DataFrame:
    """``safety_gate`` with a column ``suppressed``: the action had failed
    ``failure_limit`` times for the same pattern before the attempt."""
    decided = safety_gate(responses, cooldown_us, retry_limit, retry_window_us, protected, cooldown_after)
    known = _after_failures(decided, history, failure_limit, "left")
    return known.withColumn("suppressed", F.col("failed_us").isNotNull()).drop("failures", "failed_us", *[f"_{c}" for c in PATTERN])


def approval_gate(actions: DataFrame, approvals: DataFrame) -> DataFrame:
    """High-risk actions wait for an approval.

    ``actions`` has ``incident_id, action, requires_approval``; ``approvals``
    has ``incident_id, action, approved, decided_at``, the last one counts.
    """
    last = approvals.groupBy("incident_id", "action").agg(
        F.max_by("approved", "decided_at").alias("_approved")
    )
    return (
        actions.join(last, ["incident_id", "action"], "left")
        .withColumn(
            "approval",
            F.when(~F.col("requires_approval"), "not_needed")
            .when(F.col("_approved"), "approved")
            .when(~F.col("_approved"), "denied")
            .otherwise("awaiting_approval"),
        )
        .drop("_approved")
    )


PATTERN = ["error", "service", "action"]


def failed_patterns(history: DataFrame, limit: int = 1) -> DataFrame:
    """Patterns whose action failed at least ``limit`` times: how often, and when
    (``failed_us``) it had failed ``limit`` times.

    Failures are counted per time first; their running count is over ranges, so
    a pattern that fails all the time is spread over tasks.
    """
    failed = history.filter("status = 'failed'").groupBy(
        *PATTERN, fields.micros(F.col("executed_at")).alias("_us")).agg(F.count("*").alias("_n"))
    counted = with_running_sum(failed, PATTERN, ["_us"], "_n", "_so_far")
    return counted.filter(F.col("_so_far") >= limit).groupBy(*PATTERN).agg(
        F.max("_so_far").alias("failures"), F.min("_us").alias("failed_us"))


def _after_failures(responses: DataFrame, history: DataFrame, limit: int, how: str) -> DataFrame:
    """Responses joined with the patterns that had failed before their time."""
    bad = failed_patterns(history, limit).withColumnsRenamed({c: f"_{c}" for c in PATTERN})
    same = [F.col(c) == F.col(f"_{c}") for c in PATTERN]
    late = fields.micros(F.col("created_at")) > F.col("failed_us")
    return responses.join(bad, [*same, late], how)


def suppress_failed(responses: DataFrame, history: DataFrame, limit: int = 1) -> DataFrame:
    """Planned actions without those that had failed ``limit`` times before for
    the same pattern; later failures, and an attempt's own, do not count."""
    return _after_failures(responses, history, limit, "left_anti")


def suppressed(responses: DataFrame, history: DataFrame, limit: int = 1) -> DataFrame:
    return _after_failures(responses, history, limit, "inner").drop(*[f"_{c}" for c in PATTERN])


def escalations(responses: DataFrame) -> DataFrame:
    """Failed responses as status changes to ``escalated``."""
    return responses.filter("status = 'failed'").select(
        F.col("incident_id").alias("id"),
        F.lit("escalated").alias("status"),
        F.col("executed_at").alias("changed_at"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def execution_results(responses: DataFrame) -> DataFrame:
    """Executed responses as result records."""
    return responses.select(
        fields.digest(
            F.lit("exec"), F.col("incident_id"), F.col("action"),
            fields.micros(F.col("executed_at")).cast("string"),
        ).alias("execution_id"),
        F.col("executed_at").alias("timestamp"),
        "status",
        F.concat_ws(" ", "action", F.lit("on"), "service", F.lit("for"), "error").alias("message"),
    )
