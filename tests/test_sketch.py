"""Quantiles from counts that add up."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import sketch

DDL = "k string, us bigint, v bigint"
HOUR = 3_600_000_000


def rows(rng, n):
    return [(rng.choice(["a", "a", "b", None]), rng.randrange(10 * HOUR), int(10 ** (rng.random() * 12))) for _ in range(n)]


def of(spark, data, bits=7):
    return sketch.cells(spark.createDataFrame(data, DDL), ["k"], F.col("us"), F.col("v"), HOUR, bits)


def test_cells(spark):
    values = [0, 1, 255, 256, 257, 2**40 + 1, 2**63 - 1, -5]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", sketch.cell(F.col("v"), 7).alias("c"))
    got = {r.v: r.c for r in df.collect()}
    assert got == {0: 0, 1: 1, 255: 255, 256: 256, 257: 256, 2**40 + 1: 2**40, 2**63 - 1: 255 << 55, -5: 0}


@pytest.mark.parametrize("bits", [3, 7])
def test_within_the_bound_of_the_exact_rank(spark, bits):
    data = rows(random.Random(bits), 3000)
    points = (0.0001, 0.25, 0.5, 0.95, 0.999, 1.0)
    found = sketch.quantiles(of(spark, data, bits), ["k"], points, HOUR, 9 * HOUR).collect()
    assert {r.k for r in found} == {"a", "b", None}
    for r in found:
        values = sorted(v for k, us, v in data if k == r.k and HOUR <= us < 9 * HOUR)
        assert r["values"] == len(values)
        for p in points:
            exact = values[max(0, math.ceil(round(p * len(values), 9)) - 1)]
            got = r[f"p{p * 100:g}"]
            assert got <= exact < got * (1 + 2**-bits) or got == exact


def test_merged_parts_equal_the_whole_and_size_is_bounded(spark):
    data = rows(random.Random(3), 4000)
    whole = sketch.merged(of(spark, data), ["k"])
    parts = of(spark, data[:700]).unionByName(of(spark, data[700:3000])).unionByName(of(spark, data[3000:]))
    assert sorted(map(str, sketch.merged(parts, ["k"]).collect())) == sorted(map(str, whole.collect()))
    hot = spark.range(300_000).select(F.lit("a").alias("k"), F.lit(0).alias("us"), (F.col("id") % 5000).alias("v"))
    few = sketch.cells(hot, ["k"], F.col("us"), F.col("v"), HOUR, 4)
    assert few.count() <= 13 * 16 and few.agg(F.sum("n")).first()[0] == 300_000


def test_stream_equals_batch(spark, tmp_path):
    data = rows(random.Random(4), 900) + [("a", 5, None), ("c", 5, None)]
    for i in range(3):
        spark.createDataFrame(data[i::3], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sketch.follow(stream, str(tmp_path), ["k"], F.col("us"), F.col("v"), HOUR).awaitTermination()
    got = sketch.quantiles(sketch.stored(spark, str(tmp_path)), ["k"])
    want = sketch.quantiles(of(spark, data), ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_no_values(spark):
    assert sketch.quantiles(of(spark, []), ["k"]).count() == 0
    assert sketch.quantiles(of(spark, [("a", 1, None)]), ["k"]).count() == 0
