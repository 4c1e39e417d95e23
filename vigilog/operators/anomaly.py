"""Error frequency per service and its statistical outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilog.functions import fields


def is_error() -> Column:
    """A log row that reports a failure."""
    return F.col("log_level").isin("ERROR", "CRITICAL", "ALERT")


def error_rate(logs: DataFrame, window_us: int) -> DataFrame:
    """Events and errors per service and tumbling window."""
    return (
        logs.withColumn(
            "window_start_us", fields.floor_to(fields.micros(F.col("timestamp")), window_us)
        )
        .groupBy("service_name", "window_start_us")
        .agg(F.count("*").alias("events"), F.count_if(is_error()).alias("errors"))
        .withColumn("error_rate", F.round(F.col("errors") / F.col("events"), 6))
    )


def anomalies(
    rates: DataFrame,
    history: int = 24,
    z_limit: float = 2.0,
    factor: float = 3.0,
    threshold: int | None = None,
    value: str = "errors",
) -> DataFrame:
    """Compare each window with the ``history`` windows before it.

    ``rates`` has one row per service and window, so a service's rows here
    grow with time, not with log volume. A flat or missing history gives no
    z-score.
    """
    past = Window.partitionBy("service_name").orderBy("window_start_us").rowsBetween(-history, -1)
    x = F.col(value).cast("double")
    out = rates.withColumns(
        {
            "moving_avg": F.round(F.avg(x).over(past), 6),
            "moving_std": F.round(F.stddev_pop(x).over(past), 6),
        }
    )
    return _judged(out, x, z_limit, factor, threshold)


def _judged(out: DataFrame, x: Column, z_limit: float, factor: float, threshold: int | None) -> DataFrame:
    spread = F.col("moving_std")
    z = F.when(spread > 0, F.round((x - F.col("moving_avg")) / spread, 6))
    over = F.lit(False) if threshold is None else x > threshold
    return out.withColumn("zscore", z).withColumns(
        {
            "is_zscore": F.coalesce(F.abs("zscore") > z_limit, F.lit(False)),
            "is_moving_avg": F.coalesce(x > F.col("moving_avg") * factor, F.lit(False)),
            "is_threshold": F.coalesce(over, F.lit(False)),
        }
    )


def dense_anomalies(
    rates: DataFrame,
    window_us: int,
    history: int = 24,
    z_limit: float = 2.0,
    factor: float = 3.0,
    threshold: int | None = None,
    value: str = "errors",
    until_us: int | None = None,
) -> DataFrame:
    """As ``anomalies``, with silent windows as windows of no events: each is compared
    with the ``history`` windows of time before it, since the service's first window.

    Silent windows are filled in up to ``until_us``, the end of time, or else up to the
    latest window of ``rates``; of a longer silence only the first ``history`` windows,
    as after that all is 0 and nothing can be flagged. The moments (count, sum, sum of
    squares) are whole numbers, which add up alike in any order. Rows without a time
    are in no window. ``rates`` may have ``first_us``, the service's first window, if
    it does not reach back to it.
    """
    if threshold is not None and threshold < 0:
        raise ValueError("a threshold below 0 would flag every silent window")
    rows = rates.filter(F.col("window_start_us").isNotNull())
    start, whole = F.col("window_start_us"), Window.partitionBy("service_name")
    if "first_us" not in rows.columns:
        rows = rows.withColumn("first_us", F.min(start).over(whole))
    if until_us is None:
        end = rows.agg(F.max(start)).scalar() + window_us
    else:
        rows, end = rows.filter(start < until_us), F.lit(until_us).cast("bigint")
    ends = F.least(
        F.coalesce(F.lead(start).over(whole.orderBy("window_start_us")), end) - window_us,
        start + history * window_us)
    filled = (
        rows.withColumn("_ends", ends)
        .withColumn("_at", F.explode(F.sequence(start, F.col("_ends"), F.lit(window_us).cast("bigint"))))
        .withColumn("_seen", F.col("_at") == start)
        .select(
            "service_name", F.col("_at").alias("window_start_us"), "first_us",
            *[F.when(F.col("_seen"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in ("events", "errors")])
    )
    past = whole.orderBy("window_start_us").rangeBetween(-history * window_us, -window_us)
    x = F.col(value).cast("decimal(18,0)")
    n = F.least(F.lit(history), (start - F.col("first_us")) / window_us).cast("decimal(9,0)")
    moments = filled.withColumn("_n", n).withColumns(
        {"_sum": F.coalesce(F.sum(x).over(past), F.lit(0)).cast("decimal(18,0)"),
         "_squares": F.coalesce(F.sum((x * x).cast("decimal(28,0)")).over(past), F.lit(0)).cast("decimal(28,0)")})
    times = (F.col("_n") * F.col("_squares") - F.col("_sum") * F.col("_sum")).cast("double")
    known, n = F.col("_n") > 0, F.col("_n").cast("double")
    out = moments.withColumns(
        {"moving_avg": F.when(known, F.round(F.col("_sum").cast("double") / n, 6)),
         "moving_std": F.when(known, F.round(F.sqrt(times) / n, 6))}).drop("_n", "_sum", "_squares", "first_us")
    return _judged(out, F.col(value).cast("double"), z_limit, factor, threshold)


def flagged(scored: DataFrame) -> DataFrame:
    return scored.filter("is_zscore or is_moving_avg or is_threshold")
