"""Order-dependent steps that stay even when one key holds most rows.

A window partitioned by a hot key would put that key into one task. Here rows
are range-partitioned by (key, order), so a hot key spreads over many ranges.
Each task walks its sorted rows once and adds one row about its edges; a join
with these few rows, one for each task, completes what began in an earlier range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vigilog.session import cut


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Globally ordered ranges, numbered by ``_range``, evaluated once.

    The last sort column tells apart identical copies, so that a large group
    of copies can be split too.
    """
    by = [*keys, *order, "_copy"]
    out = (
        df.withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_range", F.spark_partition_id())
    )
    return cut(out)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join by name in which null keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def text_key(keys: list[str]) -> Column:
    """One text out of the key columns, different for different keys."""
    parts = []
    for k in keys:
        text = F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\"))
        parts.append(F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\\0")))
    return F.concat_ws("|", *parts)


# --- the walk over sorted rows -------------------------------------------------


class _Walk:
    """A task's sorted batches, with the runs of equal keys in each."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches
        self.task = TaskContext.get().partitionId()
        self.first = self.last = None  # keys
        self.shape: pa.Schema | None = None
        self.runs = 0

    def __iter__(self):
        """(batch, starts of its runs, whether the first run goes on from the
        batch before, how many of its rows are in the task's first run)."""
        for batch in self.batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            goes_on = self.runs > 0 and keys[0] == self.last
            if not self.runs:
                self.first = keys[0]
            in_first = 0
            if self.runs == int(goes_on):
                in_first = int(starts[1]) if len(starts) > 1 else len(keys)
            self.runs += len(starts) - int(goes_on)
            self.last, self.shape = keys[-1], batch.schema
            yield batch, starts, goes_on, in_first


def _walked(df: DataFrame, keys: list[str], order: list[str], kinds: list[T.StructField],
            walk: Callable[[_Walk], Iterator]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` in ranges with the new columns ``kinds`` that ``walk``
    makes, and the reports of the tasks, evaluated once.

    ``walk`` gives (batch, its new columns, its number of rows in the first run)
    for each batch and at last the values of the task's report.
    """
    by = ["_key", *order, "_copy"]
    rows = (
        df.withColumns({"_key": text_key(keys), "_copy": F.monotonically_increasing_id()})
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
    )
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema], *kinds,
        # The task, at rows of its first run; at its report, with both keys.
        T.StructField("_task", T.IntegerType()), T.StructField("_report", T.IntegerType()),
        T.StructField("_first_key", T.StringType()),
    ])
    names = schema.fieldNames()
    n_new = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = _Walk(batches)
        new_types: list[pa.DataType] = []
        report = None
        for item in walk(walked):
            if len(item) == 1:
                report = item[0]
                continue
            batch, new, in_first = item
            new_types = [x.type for x in new]
            n = batch.num_rows
            task = pa.array(np.full(n, walked.task, np.int32), mask=np.arange(n) >= in_first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new, task, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
        if walked.shape is not None and report is not None:
            blank = [pa.array([walked.last], pa.string()) if f.name == "_key" else pa.nulls(1, f.type) for f in walked.shape]
            made = [v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(report, new_types)]
            yield pa.RecordBatch.from_arrays(
                [*blank, *made, pa.nulls(1, pa.int32()), pa.array([walked.task], pa.int32()),
                 pa.array([walked.first], pa.string())], names)

    done = cut(rows.mapInArrow(run, schema))
    reports = done.filter("_report is not null").select(
        F.col("_report").alias("_task"), "_first_key", F.col("_key").alias("_last_key"), *names[len(names) - 3 - n_new : -3])
    return done.filter("_report is null").drop("_report", "_first_key"), reports


def _carried(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with what ``edges`` (one row for each task) bring to its first run."""
    return rows.join(F.broadcast(edges), "_task", "left").drop("_task", "_key", "_copy")


def _before(reports: DataFrame, value: str, how: Callable[[Column], Column]) -> DataFrame:
    """(_task, _carry): ``value`` aggregated over the earlier tasks whose last key
    is the task's first key."""
    # One row to give and one to ask for each task.
    both = reports.select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_asks")
    ).withColumn("_of", F.when(F.col("_asks"), F.col("_first_key")).otherwise(F.col("_last_key")))
    earlier = Window.partitionBy("_of").orderBy("_task").rangeBetween(Window.unboundedPreceding, -1)
    given = F.when(~F.col("_asks"), F.col(value))
    return both.withColumn("_carry", how(given).over(earlier)).filter("_asks").select("_task", "_carry")


def _append(carry: pa.Array | None, column: pa.Array) -> pa.Array:
    """``column`` with one value in front."""
    return pa.concat_arrays([pa.nulls(1, column.type) if carry is None else carry, column])


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]
) -> DataFrame:
    """Add the preceding row's values per key: ``columns`` is source -> new name."""
    old = list(columns)
    kinds = [T.StructField(f"_p{i}", df.schema[c].dataType) for i, c in enumerate(old)]

    def walk(walked: _Walk):
        last: list[pa.Array | None] = [None] * len(old)
        first = True
        for batch, starts, goes_on, _ in walked:
            n = batch.num_rows
            fresh = np.zeros(n, bool)
            fresh[starts[1:] if goes_on else starts] = True
            at = pa.array(np.arange(n), mask=fresh)
            new = [_append(last[i], batch.column(c)).take(at) for i, c in enumerate(old)]
            last = [batch.column(c).slice(n - 1) for c in old]
            # Only the very first row of a task may have its predecessor elsewhere.
            yield batch, new, int(first)
            first = False
        yield (last,)

    rows, reports = _walked(df, keys, order, kinds, walk)
    parts = F.struct("_last_key", *[f"_p{i}" for i in range(len(old))])
    edges = reports.withColumn("_e", F.lag(parts).over(Window.orderBy("_task")))
    edges = edges.filter(F.col("_e._last_key") == F.col("_first_key")).select("_task", "_e")
    out = _carried(rows, edges)
    return out.withColumns({
        new: F.when(F.col("_e").isNotNull(), F.col("_e")[f"_p{i}"]).otherwise(F.col(f"_p{i}"))
        for i, new in enumerate(columns.values())
    }).drop("_e", *[f"_p{i}" for i in range(len(old))])


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Add the sum of ``value``, a whole number, from the key's first row up to
    this row; null counts as 0."""
    kinds = [T.StructField("_s", T.LongType())]
    rows_in = df.withColumn("_v", F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint")))

    def walk(walked: _Walk):
        carry = 0
        for batch, starts, goes_on, in_first in walked:
            sums = np.cumsum(batch.column("_v").to_numpy())
            base = np.r_[0, sums[starts[1:] - 1]]
            if goes_on:
                base[0] = -carry
            sums -= np.repeat(base, np.diff(np.r_[starts, len(sums)]))
            carry = int(sums[-1])
            yield batch, [pa.array(sums)], in_first
        yield ([carry],)

    rows, reports = _walked(rows_in, keys, order, kinds, walk)
    out = _carried(rows, _before(reports, "_s", F.sum))
    return out.withColumn(name, F.col("_s") + F.coalesce("_carry", F.lit(0))).drop("_s", "_carry", "_v")


def with_last(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Add the last non-null ``value`` of the key up to and with this row."""
    kinds = [T.StructField("_l", df.schema[value].dataType)]

    def walk(walked: _Walk):
        carry = None
        for batch, starts, goes_on, in_first in walked:
            column = batch.column(value)
            n = batch.num_rows
            there = column.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(there, np.arange(n), -1))
            begin = np.repeat(starts, np.diff(np.r_[starts, n]))
            none = at < begin
            at += 1
            if goes_on and carry is not None:
                own = none & (begin == 0)
                at[own], none = 0, none & ~own
            filled = _append(carry, column).take(pa.array(at, mask=none))
            carry = filled.slice(n - 1)
            yield batch, [filled], in_first
        yield ([carry],)

    rows, reports = _walked(df, keys, order, kinds, walk)
    out = _carried(rows, _before(reports, "_l", lambda c: F.last(c, ignorenulls=True)))
    return out.withColumn(name, F.coalesce("_l", "_carry")).drop("_l", "_carry")
