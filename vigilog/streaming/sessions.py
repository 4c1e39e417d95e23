"""Session incidents of a stream, joined by late rows and taken back where they change.

What is kept of a session is one row: its first and last time, its count, the highest
severity, its first and last signal. More rows only make sessions longer or join them,
so rows of this shape merge: a micro-batch folds its signals into slots as long as the
gap, puts them next to the open sessions, and joins what lies within the gap of each
other. A hot key is folded before the shuffle; after it, it has one row for each open
session and each slot of the micro-batch.

Below ``root``: ``changes``, where a session that changed is taken back (``op`` -1) and
given out anew (1), so that the sum of ``op`` tells which rows hold; ``closed``, sessions
that no row can join any more, because the horizon, ``lateness_us`` behind the latest
signal, is more than the gap past them; ``links``, the signals with the slots they are
in; ``late``, signals behind the horizon; and two slots in turn of the open sessions and
the mark, so that a micro-batch that is run again replaces what its first try wrote.

``sessions`` and ``session_links`` are those of ``correlate.incident_sessions`` and
``correlate.session_links`` over all signals but the late ones, at any time. A link does
not name a session, which may still be joined with another: all signals of a key in one
slot are in one session, so it is found by the slot. Signals without a time are one
session for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions import classify, fields
from vigilog.operators.correlate import SESSION_KEYS, session_id, session_rows
from vigilog.operators.ordered import join_keys
from vigilog.session import cut
from vigilog.streaming.incremental import read_if_there

_KEPT = ["_min", "_max", "n", "rank", "first", "last"]
_MARK = "horizon bigint, latest bigint, batch bigint"


def _placed(signals: DataFrame, gap_us: int) -> DataFrame:
    at = fields.micros(F.col("detected_at"))
    return signals.select(
        "signal_id", "service", F.col("signal_type").alias("error"), "severity", at.alias("us"),
        fields.floor_to(at, gap_us).alias("_slot"))


def _folded(placed: DataFrame) -> DataFrame:
    place = F.struct(F.col("us"), F.col("signal_id"))
    return placed.groupBy(*SESSION_KEYS, "_slot").agg(
        F.min("us").alias("_min"), F.max("us").alias("_max"), F.count("*").alias("n"),
        F.max(classify.severity_rank(F.col("severity"))).alias("rank"), F.min(place).alias("first"),
        F.max(place).alias("last")).drop("_slot")


def marked(pieces: DataFrame, gap_us: int) -> DataFrame:
    """Pieces of sessions with ``session_start_us`` of the session they are in, and
    ``_changed``: whether it is another one than the one piece it may have been."""
    by = Window.partitionBy(*SESSION_KEYS).orderBy("_min", "_max")
    before = F.max("_max").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (F.col("_min") - before > gap_us)
    whole = Window.partitionBy(*SESSION_KEYS, "session_start_us")
    return (
        pieces.withColumn("_open", F.when(opens, F.col("_min")))
        .withColumn("session_start_us", F.last("_open", ignorenulls=True).over(
            by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_open")
        .withColumn("_changed", F.max("_new").over(whole))
    )


def _joined(pieces: DataFrame) -> DataFrame:
    """One row for each session of ``marked`` pieces."""
    return pieces.groupBy(*SESSION_KEYS, "session_start_us").agg(
        F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("n").alias("n"), F.max("rank").alias("rank"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.first("_changed").alias("_changed"))


def _rows(kept: DataFrame) -> DataFrame:
    return session_rows(kept.select(
        *SESSION_KEYS, F.col("_min").alias("session_start_us"), F.col("n").alias("occurrence_count"),
        F.col("_max").alias("updated_us"), "rank", F.col("first.signal_id").alias("first_signal"),
        F.col("last.signal_id").alias("last_signal")))


def merge_batch(batch: DataFrame, number: int, root: str, gap_us: int, lateness_us: int) -> None:
    """Takes in micro-batch ``number``; may be run again until the next one has begun."""
    spark, slot = batch.sparkSession, number % 2
    mark = _mark(spark, root, number)
    placed = _placed(batch, gap_us)
    if mark is not None and mark.horizon is not None:
        late = F.coalesce(F.col("us") <= mark.horizon, F.lit(False))
        placed.filter(late).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        placed = placed.filter(~late)
    placed.write.mode("overwrite").parquet(f"{root}/links/batch={number}")
    # Read again from there, so that the signals are not computed anew.
    links = spark.read.parquet(f"{root}/links/batch={number}")
    latest = links.agg(F.max("us")).first()[0]
    if mark is not None and mark.latest is not None:
        latest = mark.latest if latest is None else max(latest, mark.latest)
    horizon = None if latest is None else latest - lateness_us
    pieces = _folded(links).withColumn("_new", F.lit(True))
    if mark is not None:
        old = spark.read.parquet(f"{root}/open/slot={1 - slot}").withColumn("_new", F.lit(False))
        pieces = pieces.unionByName(old)
    pieces = cut(marked(pieces, gap_us))
    after = _joined(pieces)
    back = _rows(pieces.filter(F.col("_changed") & ~F.col("_new"))).withColumn("op", F.lit(-1))
    anew = _rows(after.filter("_changed")).withColumn("op", F.lit(1))
    back.unionByName(anew).write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
    ended = F.lit(False) if horizon is None else F.coalesce(F.col("_max") + gap_us <= horizon, F.lit(False))
    kept = after.select(*SESSION_KEYS, *_KEPT)
    kept.filter(ended).write.mode("overwrite").parquet(f"{root}/closed/batch={number}")
    kept.filter(~ended).write.mode("overwrite").parquet(f"{root}/open/slot={slot}")
    spark.createDataFrame([(horizon, latest, number)], _MARK).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/mark/slot={slot}")


def follow(
    signals: DataFrame, root: str, gap_us: int, lateness_us: int, trigger: dict | None = None
) -> StreamingQuery:
    """Start a query that keeps the sessions of a stream of signals."""
    root = root.rstrip("/")
    return (
        signals.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, root, gap_us, lateness_us))
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


def _upto(spark: SparkSession, root: str, what: str, batch: int) -> DataFrame:
    """The rows of all finished micro-batches."""
    return spark.read.parquet(f"{root}/{what}").filter(F.col("batch") <= batch)


def _all(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    mark = _mark(spark, root)
    if mark is None:
        raise ValueError(f"no micro-batch has been finished below {root}")
    closed = _upto(spark, root, "closed", mark.batch).drop("batch")
    return closed.unionByName(spark.read.parquet(f"{root}/open/slot={mark.batch % 2}")), mark.batch


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions as they stand, open and closed."""
    return _rows(_all(spark, root.rstrip("/"))[0])


def session_changes(spark: SparkSession, root: str) -> DataFrame:
    """Sessions given out and taken back, with ``batch`` and ``op``."""
    return _upto(spark, root.rstrip("/"), "changes", _all(spark, root.rstrip("/"))[1])


def session_links(spark: SparkSession, root: str, gap_us: int) -> DataFrame:
    """Which session each signal belongs to as things stand, one row per signal."""
    kept, batch = _all(spark, root.rstrip("/"))
    first, last = (fields.floor_to(F.col(c), gap_us) for c in ("_min", "_max"))
    slots = kept.select(
        *SESSION_KEYS, F.col("_min").alias("session_start_us"),
        F.explode_outer(F.sequence(first, last, F.lit(gap_us).cast("bigint"))).alias("_slot"))
    links = _upto(spark, root.rstrip("/"), "links", batch).select("signal_id", *SESSION_KEYS, "_slot")
    return join_keys(links, slots, [*SESSION_KEYS, "_slot"], "inner").select(session_id().alias("incident_id"), "signal_id")
