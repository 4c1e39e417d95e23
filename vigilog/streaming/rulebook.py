"""Rules from a table on a stream, while the table changes.

Each micro-batch reads the table anew and enters the versions it has not seen into a
ledger. A version is in force from its ``valid_from``, or, if events from then on have
been judged before it was published, from the first instant after them: no event is
judged twice, and the ledger tells what every event was judged by. So the signals are
those of ``rulebook.evaluate`` and ``evaluate_windows`` over the same logs with
``rules_in_force``, which is the table itself if its versions are published in time.

Windowed versions count on their own, as in batch. When a version is replaced, its
counts go on with the events of its time that are still to come within the allowed
lateness, next to those of the version after it, and end when the horizon has passed.

What a published version says is fixed. One that cannot be judged, or that says
something else under a known rule, number and start, does not stop the stream: it is in
``refused_rules`` with its problem. Versions that are taken out of the table stay in
force; a later version ends them.

Below ``root``: ``signals``; ``late``, the matches of windowed rules behind the horizon,
which per-event rules do judge; and two slots in turn of the ledger, the open rows and
the mark, so that a micro-batch that is run again reads what its first try read and
replaces what it wrote. The mark is written last; what it names is what is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog import schema
from vigilog.functions import fields
from vigilog.operators import rulebook, windows
from vigilog.session import cut
from vigilog.streaming.incremental import read_if_there

_RULE = schema.RULE_SCHEMA.fieldNames()
_PLACE = ["rule_id", "version", "published_from"]
_MARK = "horizon bigint, judged bigint, batch bigint"
IN_FORCE, SUPERSEDED, REFUSED = "in force", "superseded", "refused"


def _content():
    """Tells two rules apart by all that they say."""
    return fields.digest(*[F.col(c).cast("string") for c in _RULE if c != "valid_from"], F.col("published_from"))


def entered(
    table: DataFrame, ledger: DataFrame | None, columns: list[str], judged_us: int | None
) -> DataFrame:
    """The ledger after a look at the table: its rows and those of the versions that
    were not in it. ``judged_us`` is the time of the latest event judged so far."""
    start = F.col("published_from")
    if judged_us is not None:
        start = F.greatest(start, F.timestamp_micros(F.lit(judged_us + 1)))
    new = (
        rulebook.judged(table, columns).withColumn("published_from", F.col("valid_from"))
        .withColumn("content", _content()).dropDuplicates(["content"])
        .withColumn("valid_from", F.when(F.col("published_from").isNotNull(), start))
        .withColumn("state", F.when(F.col("problem").isNull(), IN_FORCE).otherwise(REFUSED))
    )
    if ledger is not None:
        known = ledger.filter(F.col("state") != REFUSED).select(*_PLACE, F.lit(True).alias("known"))
        new = new.join(ledger.select("content"), "content", "left_anti").join(known, _PLACE, "left")
    else:
        new = new.withColumn("known", F.lit(None).cast("boolean"))
    # Of two that are published at once for one place, one is in force.
    first = Window.partitionBy(*_PLACE, "state").orderBy("content")
    again = (F.col("state") == IN_FORCE) & (F.col("known") | (F.row_number().over(first) > 1))
    new = new.withColumn("again", F.coalesce(again, F.lit(False)))
    new = new.withColumn("problem", F.when(F.col("again"), "version says something else").otherwise(F.col("problem")))
    new = new.withColumn("state", F.when(F.col("again"), REFUSED).otherwise(F.col("state")))
    new = new.select(*_RULE, "published_from", "content", "problem", "state", F.lit(True).alias("is_new"))
    if ledger is not None:
        new = new.unionByName(ledger.withColumn("is_new", F.lit(False)))
    # A version that comes when a higher one is in force already is never used.
    higher = Window.partitionBy("rule_id", "state").orderBy("published_from", "version").rowsBetween(
        1, Window.unboundedFollowing)
    over = (F.col("state") == IN_FORCE) & F.col("is_new") & (F.min("valid_from").over(higher) <= F.col("valid_from"))
    return new.withColumn("state", F.when(over, SUPERSEDED).otherwise(F.col("state"))).drop("is_new")


def _in_force(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("state") == IN_FORCE).select(*_RULE)


def _settings(book: rulebook.Rulebook, horizon: int | None) -> dict[str, tuple[int, int]]:
    """Count and window of the windowed versions that may have open rows or get new
    ones; those long replaced are left out."""
    table = book.of_kind(True)
    if horizon is not None:
        ends = fields.micros(F.col("valid_to")) + F.col("window_s") * F.lit(1_000_000).cast("bigint")
        table = table.filter(F.col("valid_to").isNull() | (ends > horizon))
    rows = table.select(rulebook.version_key().alias("key"), "count", "window_s").collect()
    return {r.key: (r["count"], r.window_s * 1_000_000) for r in rows}


def _play(rows: DataFrame, settings: dict[str, tuple[int, int]]) -> DataFrame:
    if not settings:
        return rows.filter(F.lit(False))
    return windows.emit_and_reset_rules(rows, "run_key", "us", "place", settings, stored=True)


def step(
    new: DataFrame, held: DataFrame | None, before_us: int | None, horizon_us: int | None,
    settings: dict[str, tuple[int, int]],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One micro-batch of windowed rules: (fired rows, open rows, late rows).

    As ``incremental.step`` for many rules at once, each with its own window. Rows are
    of ``rulebook.counted`` with ``window_us`` and ``place``, which orders the rows of
    one instant and tells copies of an event apart.
    """
    late = new.filter(F.lit(False))
    if before_us is not None:
        late, new = new.filter(F.col("us") <= before_us), new.filter(F.col("us") > before_us)
    rows = new if held is None else held.unionByName(new)
    if horizon_us is None:
        return rows.filter(F.lit(False)), rows, late
    fired = _play(rows.filter(F.col("us") <= horizon_us), settings)
    last = fired.groupBy("run_rule", "run_key").agg(F.max(F.struct("us", "place")).alias("_last"))
    after = F.col("_last").isNull() | (F.struct("us", "place") > F.col("_last"))
    still = (
        rows.filter(F.col("us") >= F.lit(horizon_us) - F.col("window_us"))
        .join(last, ["run_rule", "run_key"], "left")
        .filter(after | (F.col("us") > horizon_us))
        .select(*rows.columns)
    )
    return fired, still, late


def judge_batch(
    batch: DataFrame, number: int, read_rules: Callable[[], DataFrame], root: str, lateness_us: int
) -> None:
    """Judges micro-batch ``number``; may be run again until the next one has begun."""
    spark = batch.sparkSession
    slot = number % 2
    mark = _mark(spark, root, number)
    before = mark.horizon if mark else None
    judged = mark.judged if mark else None
    old = None if mark is None else spark.read.parquet(f"{root}/ledger/slot={1 - slot}")
    entered(read_rules(), old, batch.columns, judged).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/ledger/slot={slot}")
    book = rulebook.Rulebook(_in_force(spark.read.parquet(f"{root}/ledger/slot={slot}")), batch.columns)
    # Cut once: both kinds of rule in one pass over the events, and copies numbered.
    place = F.format_string(
        "%s\u0001%020d\u0001%020d", F.coalesce("event_id", F.lit("")), F.lit(number), F.monotonically_increasing_id())
    found = cut(
        rulebook.matched(batch, book).withColumn("counts_by", rulebook.counts_by(batch.columns)).select(
            "event_id", "service_name", "timestamp", "shown", "field", "rule_id", "rule_version", "valid_from",
            "signal_type", "rule_severity", "key_field", "counts_by", "count", "window_s", place.alias("place")))
    latest = batch.agg(F.max(fields.micros(F.col("timestamp")))).first()[0]
    if latest is not None:
        judged = latest if judged is None else max(judged, latest)
    horizon = None if judged is None else judged - lateness_us
    new = rulebook.counted(found.filter("window_s is not null"), "place", "window_s").withColumn(
        "window_us", F.col("window_s").cast("bigint") * 1_000_000).drop("window_s")
    held = None if mark is None else spark.read.parquet(f"{root}/open/slot={1 - slot}")
    fired, still, late = step(new, held, before, horizon, _settings(book, before))
    signals = rulebook.event_signals(found.filter("window_s is null")).unionByName(rulebook.as_window_signals(fired))
    signals.write.mode("overwrite").parquet(f"{root}/signals/batch={number}")
    late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")
    still.write.mode("overwrite").parquet(f"{root}/open/slot={slot}")
    spark.createDataFrame([(horizon, judged, number)], _MARK).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/mark/slot={slot}")


def signals_while_rules_change(
    logs: DataFrame, read_rules: Callable[[], DataFrame], root: str, lateness_us: int, trigger: dict | None = None
) -> StreamingQuery:
    """Start a query that keeps ``root/signals`` up to date with the rules that
    ``read_rules`` gives for each micro-batch.

    Per-event rules give their signals with the micro-batch of the event, windowed
    ones when the horizon, ``lateness_us`` behind the latest event, has passed it.
    """
    root = root.rstrip("/")
    return (
        logs.writeStream.foreachBatch(lambda batch, number: judge_batch(batch, number, read_rules, root, lateness_us))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _mark(spark: SparkSession, root: str, before: int | None = None):
    """The mark of the last finished micro-batch (before one), or None."""
    found = []
    for slot in (0, 1):
        rows = read_if_there(spark, f"{root}/mark/slot={slot}")
        found += rows.collect() if rows is not None else []
    return max((r for r in found if before is None or r.batch < before), key=lambda r: r.batch, default=None)


def _slot(spark: SparkSession, root: str, what: str) -> DataFrame | None:
    mark = _mark(spark, root.rstrip("/"))
    return None if mark is None else spark.read.parquet(f"{root.rstrip('/')}/{what}/slot={mark.batch % 2}")


def rules_in_force(spark: SparkSession, root: str) -> DataFrame:
    """The versions that events have been judged by, each from when it was in force."""
    ledger = _slot(spark, root, "ledger")
    return spark.createDataFrame([], schema.RULE_SCHEMA) if ledger is None else _in_force(ledger)


def late_rules(spark: SparkSession, root: str) -> DataFrame:
    """The versions that came too late for a part of their time, or for all of it."""
    ledger = _slot(spark, root, "ledger")
    if ledger is None:
        return spark.createDataFrame([], schema.RULE_SCHEMA).withColumn("published_from", F.col("valid_from")).withColumn(
            "state", F.lit(IN_FORCE))
    late = (F.col("state") == SUPERSEDED) | (F.col("published_from") < F.col("valid_from"))
    return ledger.filter((F.col("state") != REFUSED) & late).select(*_RULE, "published_from", "state")


def refused_rules(spark: SparkSession, root: str) -> DataFrame:
    ledger = _slot(spark, root, "ledger")
    if ledger is None:
        return rulebook.judged(spark.createDataFrame([], schema.RULE_SCHEMA))
    return ledger.filter(F.col("state") == REFUSED).drop("valid_from").withColumnRenamed(
        "published_from", "valid_from").select(*_RULE, "problem")


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/signals").drop("batch")


def remaining_signals(spark: SparkSession, root: str) -> DataFrame | None:
    """Signals of windowed rules among the open rows, as if no more rows came; None
    before the first micro-batch. Changes nothing, so the stream may go on."""
    rows = _slot(spark, root, "open")
    if rows is None:
        return None
    book = rulebook.Rulebook(rules_in_force(spark, root), list(rulebook.KEY_FIELDS + rulebook.NUMERIC_FIELDS))
    return rulebook.as_window_signals(_play(rows, _settings(book, None)))
