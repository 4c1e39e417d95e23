"""The incident store against the batch state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import at
from vigilog.operators import incidents as inc
from vigilog.streaming.store import IncidentStore, changes

OPENED = "id string, service string, error string, severity string, status string, created_at timestamp"
UPDATES = "id string, status string, changed_at timestamp, seq bigint"


def tables(spark, seed, n=40, m=120):
    rng = random.Random(seed)
    opened = [(f"i{k}", rng.choice("ab"), "X", "low", "open", at(rng.randint(0, 99))) for k in range(n)]
    words = ["in_progress", "resolved", "escalated"]
    updates = [(f"i{rng.choice([0, rng.randrange(n + 3)])}", rng.choice(words), at(rng.randint(100, 160)), k) for k in range(m)]
    return spark.createDataFrame(opened, OPENED), spark.createDataFrame(updates, UPDATES)


def in_files(spark, rows, path, files, seed):
    """The rows in any order, also updates before their opening."""
    mixed = rows.collect()
    random.Random(seed).shuffle(mixed)
    size = -(-len(mixed) // files)
    for i in range(files):
        spark.createDataFrame(mixed[i * size : (i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


STATE = ["id", "service", "error", "severity", "status", "created_at", "changed_at"]


def test_store_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    opened, updates = tables(spark, 1)
    rows, path = changes(opened, updates), str(tmp_path / "in")
    stream = in_files(spark, rows.limit(90), path, 3, 2)
    IncidentStore(spark, str(tmp_path / "s"), 8).follow(stream).awaitTermination()
    rest = rows.exceptAll(rows.limit(90))
    in_files(spark, rest, path, 2, 3)
    store = IncidentStore(spark, str(tmp_path / "s"), 8)
    store.follow(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)).awaitTermination()
    known = spark.read.parquet(path)
    assert known.count() == rows.count()
    assert plain(store.state(), *STATE) == plain(inc.current_state(opened, updates), *STATE)
    ghosts = inc.missing_updates(opened, updates).groupBy("id").agg(
        F.max_by("status", F.struct("changed_at", "seq")).alias("status"), F.max("changed_at").alias("changed_at"))
    assert plain(store.missing(), "id", "status", "changed_at") == plain(ghosts, "id", "status", "changed_at")


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    opened, updates = tables(spark, 4)
    store = IncidentStore(spark, str(tmp_path), 4)
    store.merge(changes(opened, updates.limit(0)), 0)
    store.merge(changes(opened.limit(0), updates), 1)
    once = plain(store.state(), *STATE)
    store.merge(changes(opened.limit(0), updates), 1)
    assert plain(store.state(), *STATE) == once == plain(inc.current_state(opened, updates), *STATE)


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path):
    opened, updates = tables(spark, 5)
    store = IncidentStore(spark, str(tmp_path), 16)
    store.merge(changes(opened, updates.limit(0)), 0)
    one = spark.createDataFrame([("i3", "resolved", at(300), 0)], UPDATES)
    store.merge(changes(opened.limit(0), one), 1)
    versions = store.manifest()
    assert sorted(versions.values()).count(1) == 1 and len(versions) > 8
    assert len([x for x in os.listdir(tmp_path / "snapshot/version=1") if x.startswith("bucket=")]) == 1
    files = store.get(["i3"]).inputFiles()
    assert len(files) == 1 and "version=1" in files[0]
    assert store.get(["i3", "nobody"]).count() == 1


def test_vacuum_drops_what_no_manifest_refers_to(spark, tmp_path):
    opened, updates = tables(spark, 6)
    store = IncidentStore(spark, str(tmp_path), 4)
    store.merge(changes(opened, updates.limit(0)), 0)
    for n in range(1, 4):
        store.merge(changes(opened.limit(0), updates.filter(F.col("seq") % 3 == n - 1)), n)
    want = plain(store.state(), *STATE)
    assert store.vacuum(keep=1)
    assert plain(store.state(), *STATE) == want == plain(inc.current_state(opened, updates), *STATE)
    left = [b for v in os.listdir(tmp_path / "snapshot") for b in os.listdir(tmp_path / "snapshot" / v) if b.startswith("bucket=")]
    assert len(left) == len(store.manifest())
    store.merge(changes(opened.limit(0), updates), 4)
    assert plain(store.state(), *STATE) == want


def test_empty_batches(spark, tmp_path):
    opened, updates = tables(spark, 7)
    store = IncidentStore(spark, str(tmp_path), 4)
    assert store.state().count() == 0 and store.vacuum() == []
    store.merge(changes(opened.limit(0), updates.limit(0)), 0)
    assert store.state().count() == 0
    store.merge(changes(opened, updates), 1)
    assert store.state().count() == opened.count()


@pytest.mark.parametrize("status", [None, "Resolved"])
def test_odd_updates(spark, tmp_path, status):
    opened, _ = tables(spark, 8, n=2, m=0)
    odd = spark.createDataFrame([("i0", status, at(500), 0)], UPDATES)
    store = IncidentStore(spark, str(tmp_path), 2)
    store.merge(changes(opened, odd), 0)
    assert {r.id: r.status for r in store.state().collect()}["i0"] == status
