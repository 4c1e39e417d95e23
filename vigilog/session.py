"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str, app: str = "vigilog", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The last one of two equal JSON keys counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; on a
    cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="vigilog-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared folder and read it back from there.

    Used where one result feeds several consumers that must see the same
    partition boundaries, also after an executor is lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A batch input over all cores if it comes in fewer pieces than that, as
    a few compressed files do, which cannot be split; else as it is.

    For inputs whose rows are costly to decode. Large inputs have many pieces
    and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, max_rows: int = 20_000) -> bool:
    """Looks at no more than ``max_rows`` rows to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def dimension(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A configuration table for a join: broadcast if it is as small as it
    should be, which is looked up, else left to the planner."""
    return F.broadcast(df) if is_small(df, max_rows) else df
