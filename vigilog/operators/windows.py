"""Counts over trailing time ranges, with and without reset after firing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilog.operators.ordered import join_keys, with_running_sum
from vigilog.session import cut


SEPARATOR = "\u001f"
_ESCAPE = "\u001e"


def run_key(columns: tuple[str, ...] | list[str]) -> Column:
    """One text key out of zero or more columns; ``key_parts`` takes it apart.

    A value is marked by ``=`` and a null by ``-``, so that a null differs from
    an empty text and stays in its place; a separator in a value is escaped.
    """
    parts = []
    for c in columns:
        text = F.replace(F.col(c).cast("string"), F.lit(_ESCAPE), F.lit(_ESCAPE + "1"))
        text = F.replace(text, F.lit(SEPARATOR), F.lit(_ESCAPE + "2"))
        parts.append(F.coalesce(F.concat(F.lit("="), text), F.lit("-")))
    return F.concat_ws(SEPARATOR, *parts) if parts else F.lit("")


def key_parts(key: Column, columns: tuple[str, ...] | list[str]) -> dict[str, Column]:
    """The columns of a ``run_key``, as text."""
    parts = F.split(key, SEPARATOR)

    def value(i: int) -> Column:
        text = F.replace(F.substring(F.get(parts, i), 2, 1 << 30), F.lit(_ESCAPE + "2"), F.lit(SEPARATOR))
        text = F.replace(text, F.lit(_ESCAPE + "1"), F.lit(_ESCAPE))
        return F.when(F.startswith(F.get(parts, i), F.lit("=")), text)

    return {c: value(i) for i, c in enumerate(columns)}


# --- count, fire, reset -----------------------------------------------------
#
# Per key, in (us, id) order, a row fires when it is the N-th since the last
# firing with all N inside the window. Rows are range-partitioned by
# (key, us, id), so one hot key (or no key at all) spreads over all tasks. A
# task cannot know the state in which its first key arrives, but whatever it
# is, after at most N - 1 rows the task continues like one of N local runs,
# each begun before one of its first N rows. So a task plays those N runs (they
# soon coincide), marks each firing with the runs it belongs to, and reports
# N - 1 rows at either edge. A pass over these reports, a few numbers per task,
# then tells which run is the real one.

_REPORT = """
_kind string, _task int, _place int, _runs array<int>,
_rows bigint, _head array<bigint>, _tail array<bigint>, _carry array<int>
"""
_REPORT_ARROW = [
    pa.field("_kind", pa.string()), pa.field("_task", pa.int32()),
    pa.field("_place", pa.int32()), pa.field("_runs", pa.list_(pa.int32())),
    pa.field("_rows", pa.int64()), pa.field("_head", pa.list_(pa.int64())),
    pa.field("_tail", pa.list_(pa.int64())), pa.field("_carry", pa.list_(pa.int32())),
]
_CHOICE_SCHEMA = "run_key string, _task int, _run int, _hit int"


class _Run:
    """One key's rows within a task, fed in pieces."""

    def __init__(self, key: str, starts: int, n: int, window: int):
        self.key, self.n, self.window = key, n, window
        self.rows = 0
        self.tail = np.empty(0, dtype=np.int64)
        self.head = np.empty(0, dtype=np.int64)
        # Local runs by the row index from which they may fire next.
        self.ready = {i + n - 1: [i] for i in range(starts)}

    def feed(self, us: np.ndarray) -> dict[int, list[int]]:
        """Play a piece; returns the firing positions in it with their runs."""
        n, back = self.n, self.n - 1
        joined = np.concatenate([self.tail, us])
        shift = self.rows - len(self.tail)
        full = np.flatnonzero(joined[back:] - joined[: max(0, len(joined) - back)] <= self.window)
        good = full + back + shift
        fired: dict[int, list[int]] = {}
        waiting: dict[int, list[int]] = {}
        todo = list(self.ready.items())
        heapq.heapify(todo)
        while todo:
            at, runs = heapq.heappop(todo)
            spot = np.searchsorted(good, at)
            if spot == len(good):
                waiting[at] = waiting.get(at, []) + runs
                continue
            row = int(good[spot])
            # Runs that fire on the same row are one run from here on.
            while todo and todo[0][0] <= row:
                runs = runs + heapq.heappop(todo)[1]
            fired[row - self.rows] = runs
            heapq.heappush(todo, (row + n, runs))
        self.ready = waiting
        if len(self.head) < back:
            self.head = np.concatenate([self.head, us])[:back]
        self.tail = joined[len(joined) - min(back, len(joined)):]
        self.rows += len(us)
        return fired

    def carry(self) -> list[int]:
        """Rows usable for the next firing at the end, per local run."""
        back = self.n - 1
        left = {
            run: min(back, max(0, self.rows - (at - back)))
            for at, runs in self.ready.items()
            for run in runs
        }
        return [left[run] for run in sorted(left)]

    def report(self, task: int) -> dict:
        return {
            "_kind": "edge", "_task": task, "run_key": self.key, "_rows": self.rows,
            "_head": self.head.tolist(), "_tail": self.tail.tolist(),
            "_carry": self.carry(),
        }


def _play(settings: dict[str, tuple[int, int]]):
    """The per-task pass over sorted Arrow batches."""
    shortest = min(n for n, _ in settings.values())

    def out_schema(batch: pa.RecordBatch) -> pa.Schema:
        fields = [f.with_nullable(True) for f in batch.schema if f.name != "_us"]
        return pa.schema([*fields, *_REPORT_ARROW])

    def rows_out(batch: pa.RecordBatch, spots: list[int], extra: dict) -> pa.RecordBatch:
        taken = batch.drop_columns("_us").take(pa.array(spots, pa.int64()))
        blank = [None] * len(spots)
        return pa.RecordBatch.from_arrays(
            [*taken.columns,
             *[pa.array(extra.get(f.name, blank), f.type) for f in _REPORT_ARROW]],
            schema=out_schema(batch),
        )

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = run = shape = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            shape = out_schema(batch)
            keys = batch.column("run_key").to_numpy(zero_copy_only=False)
            us = batch.column("_us").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(us)]
            spots, marks, kinds, places = [], [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo > 0 and hi < len(us) and hi - lo < shortest:
                    continue  # a whole key too short to fire
                if run is None or run.key != keys[lo]:
                    n, window = settings[keys[lo].split(SEPARATOR)[0]]
                    run = _Run(keys[lo], n if first is None else 1, n, window)
                    first = first or run
                before = run.rows
                for at, runs in run.feed(us[lo:hi]).items():
                    spots.append(lo + at)
                    marks.append(sorted(runs) if run is first else None)
                    kinds.append("fired")
                    places.append(None)
                if run is first:
                    for at in range(before, min(run.n - 1, run.rows)):
                        spots.append(lo + at - before)
                        marks.append(None)
                        kinds.append("head")
                        places.append(at)
            if spots:
                yield rows_out(
                    batch, spots,
                    {"_kind": kinds, "_task": [task] * len(spots), "_place": places,
                     "_runs": marks},
                )
        if first is not None:
            edges = [first.report(task)]
            if run is not first:
                edges.append(run.report(task))
            yield pa.RecordBatch.from_pylist(edges, schema=shape)

    return play


def _choose(settings: dict[str, tuple[int, int]]):
    """Walk one key's task reports in order and pick the real run of each."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n, window = settings[pdf["run_key"].iloc[0].split(SEPARATOR)[0]]
        usable: list[int] = []
        picks = []
        for row in pdf.sort_values("_task").to_dict("records"):
            head, tail = list(row["_head"]), list(row["_tail"])
            seen, hit = list(usable), -1
            for place, us in enumerate(head):
                seen.append(us)
                if len(seen) >= n and us - seen[-n] <= window:
                    hit = place
                    break
            picks.append((row["run_key"], row["_task"], hit + 1, hit))
            if row["_rows"] >= n - 1:
                keep = int(row["_carry"][hit + 1])
                usable = tail[len(tail) - keep:]
            elif hit >= 0:
                usable = head[hit + 1:]
            else:
                usable = (usable + head)[-(n - 1):]
        return pd.DataFrame(picks, columns=["run_key", "_task", "_run", "_hit"])

    return choose


def emit_and_reset(
    df: DataFrame, key: str, us: str, order: str, n: int, window_us: int,
    stored: bool = False,
) -> DataFrame:
    """The rows of ``df`` that complete ``n`` events within ``window_us``.

    ``key`` is a text column; rows without a key or time are left out. A gap of
    exactly ``window_us`` still counts. After a firing row the count of its
    key starts afresh. ``stored`` tells that ``df`` is a stored table as it is.
    """
    one = df.withColumn("run_rule", F.lit(""))
    settings = {"": (n, window_us)}
    return emit_and_reset_rules(one, key, us, order, settings, stored).drop("run_rule")


def emit_and_reset_rules(
    df: DataFrame, key: str, us: str, order: str, settings: dict[str, tuple[int, int]],
    stored: bool = False,
) -> DataFrame:
    """``emit_and_reset`` for several rules in one shuffle: the text column
    ``run_rule`` names a row's rule, ``settings`` gives each rule's ``n`` and
    ``window_us``."""
    if any(n < 1 for n, _ in settings.values()):
        raise ValueError("n must be at least 1")
    kept = df.columns
    rows = df.filter(F.col(key).isNotNull() & F.col(us).isNotNull()).select(
        F.concat("run_rule", F.lit(SEPARATOR), key).alias("run_key"),
        F.col(us).alias("_us"),
        F.col(order).cast("string").alias("_id"),
        F.monotonically_increasing_id().alias("_copy"),
        *[F.col(c).alias(f"row_{c}") for c in kept],
    )
    if not stored:
        # Range partitioning reads its input twice, so the rows, which are few
        # compared with the logs they come from, are stored first.
        rows = cut(rows)
    by = ["run_key", "_us", "_id", "_copy"]
    schema = T.StructType(
        [T.StructField("run_key", T.StringType())]
        + [T.StructField(f"row_{c}", df.schema[c].dataType) for c in kept]
        + T.StructType.fromDDL(_REPORT).fields
    )
    played = cut(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_id", "_copy")
        .mapInArrow(_play(settings), schema)
    )
    choices = (
        played.filter("_kind = 'edge'")
        .select("run_key", "_task", "_rows", "_head", "_tail", "_carry")
        .groupBy("run_key")
        .applyInPandas(_choose(settings), _CHOICE_SCHEMA)
    )
    # At most two reports per task, so the choices are small by construction.
    real = played.filter("_kind <> 'edge'").join(
        F.broadcast(choices), ["run_key", "_task"], "left"
    )
    is_fired = (F.col("_kind") == "fired") & (
        F.col("_runs").isNull() | F.array_contains("_runs", F.col("_run"))
    )
    is_head = (F.col("_kind") == "head") & (F.col("_place") == F.col("_hit"))
    return real.filter(is_fired | is_head).select(
        *[F.col(f"row_{c}").alias(c) for c in kept]
    )


# --- trailing counts without reset ------------------------------------------


def sliding_count(
    df: DataFrame, keys: list[str], us: str, window_us: int, name: str = "in_window"
) -> DataFrame:
    """Add the number of the key's rows within ``[us - window_us, us]``.

    Equal to a RANGE window by key, computed as a difference of two running
    counts so that a hot key is not gathered in one task. Rows of one instant
    are counted together first.
    """
    return window_count(df, keys, us, window_us, 0, name)


def window_count(
    df: DataFrame, keys: list[str], us: str, before_us: int, after_us: int, name: str
) -> DataFrame:
    """Add the number of the key's rows within ``[us - before_us, us + after_us]``,
    the row itself included."""
    moments = df.groupBy(*keys, F.col(us).alias("_us")).agg(F.count("*").alias("_n"))
    # Each moment also asks, just before the moment before_us earlier, how many
    # rows came before it, and, just after the one after_us later, how many so far.
    none = F.lit(0).cast("bigint").alias("_n")

    def mark(at: Column, side: int, sign: int, n: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(side).alias("_side"), F.lit(sign).alias("_sign"), n, F.col("_us"))

    marks = [mark(F.col("_us"), 1, 0 if after_us else 1, F.col("_n")),
             mark(F.col("_us") - F.lit(before_us), 0, -1, none)]
    if after_us:
        marks.append(mark(F.col("_us") + F.lit(after_us), 2, 1, none))
    rows = moments.select(*keys, F.explode(F.array(*marks)).alias("_m")).select(*keys, "_m.*")
    counted = with_running_sum(rows, keys, ["_at", "_side"], "_n", "_sum")
    counts = counted.groupBy(*keys, "_us").agg(F.sum(F.col("_sum") * F.col("_sign")).alias(name))
    return join_keys(df, counts.withColumnRenamed("_us", us), [*keys, us], "inner")
