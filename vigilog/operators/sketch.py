"""Quantiles of whole numbers from counts that can be added up.

A sketch is a table: one row for each key, window and cell with the number of values in
it. A cell is a value cut to its ``bits + 1`` leading binary digits, so a cell's values
are less than ``2 ** -bits`` above it, relatively, and a key and window has no more than
``64 * 2 ** bits`` cells, however many values. Sketches of parts are merged by adding up
counts: by micro-batch, by window, over any range of windows and in any order, with
results equal to those of one sketch of all. So a stream appends the cells of each
micro-batch and keeps no state, and no value is ever late.

A quantile is the cell of the value at rank ``ceil(p * n)``: never above that value, and
less than ``2 ** -bits`` of the cell below it. Null values are left out; those below 0,
as latencies by skewed clocks are, count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions import fields

BITS = 7


def cell(value: Column, bits: int = BITS) -> Column:
    """The value's leading digits, the others 0."""
    x = F.greatest(value.cast("bigint"), F.lit(0).cast("bigint"))
    drop = F.greatest(F.length(F.bin(x)) - (bits + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def cells(rows: DataFrame, keys: list[str], us: Column, value: Column, window_us: int, bits: int = BITS) -> DataFrame:
    """The sketch of each key and window of time."""
    return (
        rows.withColumn("_value", value).filter("_value IS NOT NULL")
        .groupBy(*keys, fields.floor_to(us, window_us).alias("window_start_us"), cell(F.col("_value"), bits).alias("cell"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up over all that is not among ``keys``."""
    return sketch.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def quantiles(
    sketch: DataFrame, keys: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99),
    since_us: int | None = None, until_us: int | None = None,
) -> DataFrame:
    """``p50`` and so on per key, over the windows that begin within the range, with
    the number of values. Each key's cells, which are few, meet in one task."""
    if since_us is not None:
        sketch = sketch.filter(F.col("window_start_us") >= since_us)
    if until_us is not None:
        sketch = sketch.filter(F.col("window_start_us") < until_us)
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged(sketch, keys).withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    # A point has six decimals at most, so that the rank is found in whole numbers.
    rank = {p: F.ceil(F.col("_all").cast("decimal(20,0)") * F.lit(f"{p:.6f}").cast("decimal(8,6)")) for p in points}
    return ranked.groupBy(*keys).agg(
        F.first("_all").alias("values"),
        *[F.min(F.when(F.col("_upto") >= rank[p], F.col("cell"))).alias(f"p{p * 100:g}") for p in points])


def follow(
    rows: DataFrame, root: str, keys: list[str], us: Column, value: Column, window_us: int, bits: int = BITS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that appends the cells of each micro-batch below ``root``; one
    that is run again replaces its own."""
    root = root.rstrip("/")

    def on_batch(batch: DataFrame, number: int) -> None:
        cells(batch, keys, us, value, window_us, bits).write.mode("overwrite").parquet(f"{root}/cells/batch={number}")

    return (
        rows.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The sketch that a stream has written, to be merged."""
    return spark.read.parquet(f"{root.rstrip('/')}/cells").drop("batch")
