"""The last state of all incidents, kept up by micro-batches.

A snapshot lies in ``buckets`` by the hash of the incident's id, each written whole.
A micro-batch folds its changes per incident, reads the buckets that they touch,
merges and writes these under its own number. A manifest, one row for each bucket,
says under which number each is to be found; it is written last, so readers see all
of a batch or nothing of it, and a batch that is run again after a failure begins
from the manifest before it and writes the same. What a batch reads and writes grows
with the buckets it touches, not with the number of batches; a bucket never has more
files than the one write made, so there is nothing to compact, and ``vacuum`` drops
what no manifest refers to any more.

``changes`` is the log of what was folded, one folder for each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.streaming.pipeline import BACKFILL

_MANIFEST = "bucket int, version bigint, batch bigint"
#: What an opening says of its incident.
_OPENING = ["service", "error", "severity", "created_at"]
_STATE = (
    "id string, opened boolean, service string, error string, severity string, created_at timestamp, status string, "
    "changed_at timestamp, seq bigint, version bigint, bucket int"
)


def changes(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Openings and updates as rows of one shape, batch or stream."""
    opened = incidents.select(
        "id", F.lit(True).alias("opened"), *_OPENING, "status", F.lit(None).cast("timestamp").alias("changed_at"),
        F.lit(-1).cast("bigint").alias("seq"))
    none = [F.lit(None).cast(incidents.schema[c].dataType).alias(c) for c in _OPENING]
    later = updates.select(
        "id", F.lit(False).alias("opened"), *none, "status", "changed_at", F.col("seq").cast("bigint").alias("seq"))
    return opened.unionByName(later)


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each incident: what its opening says, and the status of the last
    update, or of the opening if there is none. May be folded again with more rows;
    of several openings the least row counts."""
    place = F.struct(~(F.col("opened") & F.col("changed_at").isNull()), "changed_at", "seq", "status")
    opening = F.when(F.col("opened"), F.struct(*_OPENING))
    merged = rows.groupBy(*keys).agg(
        F.max("opened").alias("opened"), F.min(opening).alias("_o"), F.max(place).alias("_s"))
    return merged.select(
        *keys, "opened", *[F.col(f"_o.{c}").alias(c) for c in _OPENING],
        F.col("_s.status").alias("status"), F.col("_s.changed_at").alias("changed_at"), F.col("_s.seq").alias("seq"))


class IncidentStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        # An empty manifest, so that the folder can be read from the first batch on.
        spark.createDataFrame([], "bucket int, version bigint").write.mode("append").parquet(f"{self.root}/manifests/batch=-1")

    # -- reading -----------------------------------------------------------------

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to version, of the last batch (before one)."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests")
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {r.bucket: r.version for r in rows.filter(F.col("batch") == last).collect()} if last is not None else {}

    def rows(self, versions: dict[int, int]) -> DataFrame:
        """The snapshot's rows in the given buckets; no other file is opened."""
        if not versions:
            return self.spark.createDataFrame([], _STATE).drop("version", "bucket")
        paths = [f"{self.root}/snapshot/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        found = self.spark.read.schema(_STATE).option("basePath", f"{self.root}/snapshot").parquet(*paths)
        return found.drop("version", "bucket")

    def state(self) -> DataFrame:
        """Incidents with their last status, as ``incidents.current_state``."""
        return self.rows(self.manifest()).filter("opened").drop("opened", "seq")

    def missing(self) -> DataFrame:
        """The last update of each incident that has not been opened."""
        return self.rows(self.manifest()).filter("NOT opened").select("id", "status", "changed_at")

    def get(self, ids: list[str]) -> DataFrame:
        """Some incidents; only their buckets are read."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string").select(self._bucket().alias("b")).distinct()
        mine = {r.b for r in wanted.collect()}
        known = {b: v for b, v in self.manifest().items() if b in mine}
        return self.rows(known).filter(F.col("opened") & F.col("id").isin(ids)).drop("opened", "seq")

    # -- writing -----------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes one micro-batch of ``changes`` into the snapshot."""
        log = f"{self.root}/changes/batch={number}"
        folded(batch, ["id"]).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(log)
        new = self.spark.read.parquet(log)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        known = self.manifest(before=number)
        if touched:
            old = self.rows({b: known[b] for b in touched if b in known}).withColumn("bucket", self._bucket())
            both = folded(old.unionByName(new), ["id", "bucket"])
            both.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy(
                "bucket").parquet(f"{self.root}/snapshot/version={number}")
        now = {**known, **{b: number for b in touched}}
        self.spark.createDataFrame(list(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifests/batch={number}")

    def follow(self, rows: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """Keeps the snapshot up with a stream of ``changes``."""
        return (
            rows.writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", f"{self.root}/_checkpoint")
            .trigger(**(trigger or BACKFILL))
            .start()
        )

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops the manifests but the last ``keep``, and the buckets and change logs
        that those do not refer to; for a time when no batch or reader runs that
        began earlier. Returns the paths dropped."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests")
        batches = sorted(r.batch for r in rows.select("batch").distinct().collect())
        kept = batches[-keep:]
        used = {(r.bucket, r.version) for r in rows.filter(F.col("batch").isin(kept)).collect()} if kept else set()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        dropped = []

        def children(path: str) -> list[str]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            system = at.getFileSystem(conf)
            return [f.getPath().getName() for f in system.listStatus(at) if f.isDirectory()] if system.exists(at) else []

        def drop(path: str) -> None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            dropped.append(path)

        def number(name: str) -> int:
            return int(name.split("=")[1])

        if not kept:
            return dropped
        # Manifests first, so that none is left that refers to what is gone.
        for folder in ("manifests", "changes"):
            for name in children(f"{self.root}/{folder}"):
                if "=" in name and 0 <= number(name) < kept[0]:
                    drop(f"{self.root}/{folder}/{name}")
        for version in children(f"{self.root}/snapshot"):
            for bucket in children(f"{self.root}/snapshot/{version}"):
                if "=" in bucket and (number(bucket), number(version)) not in used and number(version) <= kept[-1]:
                    drop(f"{self.root}/snapshot/{version}/{bucket}")
        return dropped
