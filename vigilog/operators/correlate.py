"""Signals related by time: clock windows, intervals of any place, sessions of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog import schema
from vigilog.functions import classify, fields
from vigilog.operators.ordered import join_keys, with_last, with_previous
from vigilog.operators.windows import window_count
from vigilog.session import cut


def group_id(window_us: Column, by: list[str]) -> Column:
    return fields.digest(F.lit("group"), window_us.cast("string"), *[F.col(c) for c in by])


def correlation_links(signals: DataFrame, window_us: int, by: list[str] | None = None) -> DataFrame:
    """Each signal with the id of the time window it falls in.

    The list of related signals of a group is this table, one row per signal,
    since a group may hold any number of them. ``by`` narrows groups further,
    for example to one trace.
    """
    by = by or []
    start = fields.floor_to(fields.micros(F.col("detected_at")), window_us)
    return signals.withColumn("window_start_us", start).select(
        group_id(F.col("window_start_us"), by).alias("group_id"), "window_start_us", *by,
        "signal_id", "signal_type", "service", "severity",
    )


def correlated_groups(
    signals: DataFrame,
    window_us: int,
    by: list[str] | None = None,
    n_types: int = len(schema.SIGNAL_TYPES),
    n_services: int = len(schema.SERVICES),
) -> DataFrame:
    """One row per time window with signals, with a confidence in [0, 1].

    The score is ours: share of the known signal types times share of the
    known services seen together. Signals are first counted per
    (window, service, type), which is done before the shuffle.
    """
    by = by or []
    return _scored(
        correlation_links(signals, window_us, by), ["group_id", "window_start_us", *by], n_types, n_services)


def _scored(links: DataFrame, group: list[str], n_types: int, n_services: int) -> DataFrame:
    counts = links.groupBy(*group, "service", "signal_type").agg(
        F.count("*").alias("n"),
        F.max(classify.severity_rank(F.col("severity"))).alias("rank"),
    )
    groups = counts.groupBy(*group).agg(
        F.sum("n").alias("n_signals"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.array_sort(F.collect_set("signal_type")).alias("signal_types"),
        classify.severity_name(F.max("rank")).alias("top_severity"),
    )
    types, services = F.size("signal_types"), F.size("services")
    score = F.least(F.lit(1.0), types / n_types) * F.least(F.lit(1.0), services / n_services)
    return groups.withColumns(
        {
            "n_services": services,
            "n_types": types,
            "confidence": F.round(score, 6),
            "cross_service": services > 1,
        }
    )


# --- intervals ------------------------------------------------------------------


def interval_links(signals: DataFrame, within_us: int, by: list[str] | None = None) -> DataFrame:
    """Each signal with the number of other signals at most ``within_us`` before or
    after it (``n_links``), wherever the clock's windows end, and the group of all
    that are connected by such links.

    ``by`` narrows both further, for example to one trace; nulls are one value.
    Links are counted by running sums and groups are chains of gaps, so no pair is
    ever made, and one trace, or no key at all, spreads over tasks. Signals without
    a time are linked with nothing and in no group.
    """
    by = by or []
    at = fields.micros(F.col("detected_at"))
    rows = signals.withColumn("us", at).filter("us is not null").select(
        *by, "us", *[c for c in ("signal_id", "signal_type", "service", "severity") if c not in by])
    counted = window_count(rows, by, "us", within_us, within_us, "n_links").withColumn(
        "n_links", F.col("n_links") - 1)
    slots = _chains(rows, by, within_us)
    slot = fields.floor_to(F.col("us"), within_us + 1).alias("_slot")
    return join_keys(counted.select("*", slot), slots, [*by, "_slot"], "inner").drop("_slot").withColumn(
        "group_id", fields.digest(F.lit("interval"), F.col("group_start_us").cast("string"), *[F.col(c) for c in by]))


def _chains(rows: DataFrame, by: list[str], within_us: int) -> DataFrame:
    """(by, _slot, group_start_us): rows of one slot of ``within_us`` and 1 are
    linked, so slots are chained; there are no more than the time has slots."""
    slots = rows.groupBy(*by, fields.floor_to(F.col("us"), within_us + 1).alias("_slot")).agg(
        F.min("us").alias("_min"), F.max("us").alias("_max"))
    after = with_previous(slots, by, ["_slot"], {"_max": "_before"})
    opens = F.col("_before").isNull() | (F.col("_min") - F.col("_before") > within_us)
    marked = after.withColumn("_open", F.when(opens, F.col("_min"))).select(*by, "_slot", "_open")
    return with_last(marked, by, ["_slot"], "_open", "group_start_us").select(*by, "_slot", "group_start_us")


def interval_groups(
    signals: DataFrame, within_us: int, by: list[str] | None = None,
    n_types: int = len(schema.SIGNAL_TYPES), n_services: int = len(schema.SERVICES),
) -> DataFrame:
    """One row for each group of ``interval_links``, scored as
    ``correlated_groups``, with its links (each counted once) and its end."""
    by = by or []
    links = cut(interval_links(signals, within_us, by))
    group = ["group_id", "group_start_us", *by]
    sums = links.groupBy("group_id").agg(
        F.expr("sum(n_links) div 2").alias("n_links"), F.max("us").alias("group_end_us"))
    return _scored(links, group, n_types, n_services).join(sums, "group_id")


def band_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str,
    before_us: int, after_us: int, split: int = 100_000,
) -> DataFrame:
    """Pairs of rows of equal keys with the right one's time from ``before_us``
    before to ``after_us`` after the left one's; the left row as struct ``l``, the
    right one as ``r``.

    Times are dealt into buckets as long as the band; a left row goes to its bucket
    and the one on either side that its band reaches. A bucket of more than ``split``
    rows with a large share of all pairs is dealt further: its left rows into some
    parts, its right rows into others, and each two parts meet in a cell, so no hot key
    or moment meets in one task. There are as many cells as all tasks need, however
    many rows there are, and rows are sent no more often than that takes. Copies of
    a row stay together. Null keys or times join nothing.
    """
    size = before_us + after_us + 1
    there = [F.col(k).isNotNull() for k in keys]

    def with_key(df: DataFrame, us: str, side: str) -> DataFrame:
        rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.col(us).cast("bigint").alias(f"_{side}us"), F.struct("*").alias(side))
        return rows.filter(F.col(f"_{side}us").isNotNull())

    for known in there:
        left, right = left.filter(known), right.filter(known)
    bucket = [*[f"_k{i}" for i in range(len(keys))], "_bucket"]
    low = fields.floor_to(F.col("_lus") - before_us, size)
    high = fields.floor_to(F.col("_lus") + after_us, size)
    reach = F.array_distinct(F.array(low, high))
    lefts = with_key(left, left_us, "l").withColumn("_bucket", F.explode(reach))
    rights = with_key(right, right_us, "r").withColumn("_bucket", fields.floor_to(F.col("_rus"), size))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(_cells(lefts, rights, bucket, split, CELLS_PER_TASK * tasks))

    def dealt(rows: DataFrame, kept: str, own: str, other: str) -> DataFrame:
        """To one part of its own side and all of the other."""
        parts = F.coalesce(own, F.lit(1))
        part = F.pmod(F.xxhash64(*_plain(rows, kept)), parts).cast("int").alias(f"_{own}")
        out = rows.join(hot, bucket, "left").select(*bucket, f"_{kept}us", kept, part, F.coalesce(other, F.lit(1)).alias("_n"))
        out = out.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        # By number, so that few bytes with many pairs are not put together in few tasks.
        return out.repartition(tasks, *bucket, "_lefts", "_rights")

    near = (F.col("_rus") >= F.col("_lus") - before_us) & (F.col("_rus") <= F.col("_lus") + after_us)
    pairs = dealt(lefts, "l", "lefts", "rights").join(dealt(rights, "r", "rights", "lefts"), [*bucket, "_lefts", "_rights"])
    return pairs.filter(near).select("l", "r")


#: A bucket with more than its share of the pairs is dealt into cells of such a share.
CELLS_PER_TASK = 4


def _cells(lefts: DataFrame, rights: DataFrame, bucket: list[str], split: int, cells: int) -> DataFrame:
    """The buckets to be dealt, fewer than ``cells``, with the number of parts of either side."""
    sides = lefts.groupBy(*bucket).agg(F.count("*").cast("double").alias("_l")).join(
        rights.groupBy(*bucket).agg(F.count("*").cast("double").alias("_r")), bucket)
    sides = cut(sides.withColumn("_pairs", F.col("_l") * F.col("_r")))
    share = (sides.agg(F.sum("_pairs")).first()[0] or 0.0) / cells
    many = F.ceil(F.col("_pairs") / F.lit(share or 1.0))
    # Each left row is sent to all right parts and the reverse: about the same of both is least.
    right_parts = F.least(many, F.greatest(F.lit(1), F.round(F.sqrt(many * F.col("_r") / F.col("_l")))))
    return sides.filter((F.col("_pairs") > share) & (F.col("_l") + F.col("_r") > split)).select(
        *bucket, F.ceil(many / right_parts).cast("int").alias("lefts"), right_parts.cast("int").alias("rights"))


def _plain(rows: DataFrame, side: str) -> list[Column]:
    """The columns of a side that have a hash, which maps have not."""
    kinds = rows.schema[side].dataType
    return [F.col(f"{side}.`{f.name}`") for f in kinds if "map<" not in f.dataType.simpleString()]


def gap_slots(df: DataFrame, keys: list[str], us: Column, gap_us: int, aggs: list[Column]) -> DataFrame:
    """Sessions by inactivity gap, as slots: rows within ``gap_us`` of each
    other always share a session, so rows are first folded into slots of that
    length (before the shuffle). A key then has at most one row per slot of
    time, however many rows it has. A gap of exactly ``gap_us`` still joins.
    """
    slots = (
        df.withColumn("_us", us)
        .withColumn("_slot", fields.floor_to(F.col("_us"), gap_us))
        .groupBy(*keys, "_slot")
        .agg(F.min("_us").alias("_min"), F.max("_us").alias("_max"), *aggs)
    )
    in_order = Window.partitionBy(*keys).orderBy("_slot")
    before = F.lag("_max").over(in_order)
    opens = before.isNull() | (F.col("_min") - before > gap_us)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slots.withColumn("_open", F.when(opens, F.col("_min"))).withColumn(
        "session_start_us", F.last("_open", ignorenulls=True).over(upto)
    ).drop("_open")


SESSION_KEYS = ["service", "error"]


def session_id() -> Column:
    return fields.digest(
        F.lit("session"), F.col("service"), F.col("error"),
        F.col("session_start_us").cast("string"),
    )


def _slots(signals: DataFrame, gap_us: int) -> DataFrame:
    at = fields.micros(F.col("detected_at"))
    place = F.struct(at, "signal_id")
    return gap_slots(
        signals.withColumn("error", F.col("signal_type")), SESSION_KEYS, at, gap_us,
        [
            F.count("*").alias("n"),
            F.max(classify.severity_rank(F.col("severity"))).alias("rank"),
            F.min(place).alias("first"),
            F.max(place).alias("last"),
        ],
    )


def incident_sessions(signals: DataFrame, gap_us: int) -> DataFrame:
    """Repeats of one (service, error) folded into one incident while they
    keep coming within ``gap_us``; the related signals are ``session_links``."""
    return session_rows(
        _slots(signals, gap_us)
        .groupBy(*SESSION_KEYS, "session_start_us")
        .agg(
            F.sum("n").alias("occurrence_count"),
            F.max("_max").alias("updated_us"),
            F.max("rank").alias("rank"),
            F.min("first")["signal_id"].alias("first_signal"),
            F.max("last")["signal_id"].alias("last_signal"),
        )
    )


def session_rows(folded: DataFrame) -> DataFrame:
    """Incidents of folded sessions, one row each."""
    return folded.select(
        session_id().alias("incident_id"), *SESSION_KEYS,
        F.lit("open").alias("status"), classify.severity_name(F.col("rank")).alias("priority"), "occurrence_count",
        F.create_map(
            F.lit("first_signal"), F.col("first_signal"),
            F.lit("last_signal"), F.col("last_signal"),
        ).alias("context_data"),
        F.col("session_start_us").alias("created_us"), "updated_us",
    )


def session_links(signals: DataFrame, gap_us: int) -> DataFrame:
    """Which session each signal belongs to, one row per signal."""
    at = fields.micros(F.col("detected_at"))
    slots = _slots(signals, gap_us).select(*SESSION_KEYS, "_slot", "session_start_us")
    rows = signals.withColumn("error", F.col("signal_type")).select(
        "signal_id", *SESSION_KEYS, fields.floor_to(at, gap_us).alias("_slot")
    )
    return join_keys(rows, slots, [*SESSION_KEYS, "_slot"], "inner").select(
        session_id().alias("incident_id"), "signal_id"
    )
