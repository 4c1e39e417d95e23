"""Reading log files and dimensions, writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilog import schema
from vigilog.session import spread
from vigilog.sources.log_tail import LogTail


def _with_file(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_name").alias("source_file"))


def read_log_files(spark: SparkSession, directory: str, suffix: str = ".log") -> DataFrame:
    """All lines of the log files of a directory, with their file's name."""
    return spread(_with_file(spark.read.option("pathGlobFilter", f"*{suffix}").text(directory)))


def stream_log_files(
    spark: SparkSession, directory: str, suffix: str = ".log", max_files: int | None = None
) -> DataFrame:
    """The same as a stream over finished (rotated) files."""
    reader = spark.readStream.option("pathGlobFilter", f"*{suffix}")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_file(reader.text(directory))


def tail_log_files(spark: SparkSession, directory: str, suffix: str = ".log") -> DataFrame:
    """The same as a stream over files that still grow."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("suffix", suffix).load(directory)


def playbooks(spark: SparkSession, actions: dict[str, str] | None = None) -> DataFrame:
    """The playbook dimension from a mapping of signal type to action."""
    rows = list((schema.PLAYBOOKS if actions is None else actions).items())
    return spark.createDataFrame(rows, schema.PLAYBOOK_SCHEMA)


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """The playbook dimension from a JSON file ``{signal_type: {action}}``."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<action:string>>")
    return text.select(F.explode(entries).alias("signal_type", "book")).select(
        "signal_type", "book.action"
    )


def write_by_day(df: DataFrame, path: str, at: str = "timestamp", mode: str = "append") -> None:
    """A table in day folders, so that time filters skip whole days."""
    df.withColumn("day", F.col(at).cast("date")).write.mode(mode).partitionBy("day").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as key and JSON value, the shape a message queue takes."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def from_messages(messages: DataFrame, row_schema) -> DataFrame:
    return messages.select(F.from_json(F.col("value").cast("string"), row_schema).alias("m")).select("m.*")
