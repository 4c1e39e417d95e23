"""Which files of a stored table can hold a piece of text.

For each file, the index has the runs of three characters (grams) of its lower-case
messages, as postings (gram, file) in buckets by the gram's hash, sorted. A text can
only be in files that hold all its grams, so a search reads the few buckets of these
grams and then those files alone; the predicate still decides on each row, so results
are those of a full scan. Files that the index does not know yet are always read, and
files that are gone are not looked for. Texts of fewer than three characters scan all.

Grams of a file are made distinct before and after the shuffle, so the index grows with
files and the distinct grams in them, not with rows; it pays for texts that few files
hold, as identifiers and rare words do. The names of the files to read pass through the
driver, which lists a table's files in any case.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.operators import search

_FILES = "file string, batch bigint"
_POSTINGS = "gram string, file string, batch bigint, bucket int"


def grams(text: str) -> list[str]:
    lower = text.lower()
    return sorted({lower[i:i + 3] for i in range(len(lower) - 2)})


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class TextIndex:
    """The index of one column of a Parquet table, plain or in partition folders."""

    def __init__(self, spark: SparkSession, table: str, root: str, column: str = "message", buckets: int = 64):
        self.spark, self.table, self.root = spark, table.rstrip("/"), root.rstrip("/")
        self.column, self.buckets = column, buckets

    def _stored(self, what: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{what}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], ddl)
            raise

    def _listed(self) -> list[str]:
        """The table's files, relative to it."""
        path = self.table.split("://", 1)[-1].removeprefix("file:")
        return [unquote(f).split(f"{path}/", 1)[1] for f in self.spark.read.parquet(self.table).inputFiles()]

    def _read(self, files: list[str]) -> DataFrame:
        whole = self.spark.read.parquet(self.table)
        if not files:
            return whole.filter(F.lit(False))
        reader = self.spark.read.schema(whole.schema).option("basePath", self.table)
        return reader.parquet(*[f"{self.table}/{f}" for f in files])

    def _known(self) -> dict[str, int]:
        return {r.file: r.batch for r in self._stored("files", _FILES).collect()}

    def update(self) -> int:
        """Takes in the files that are new; returns how many. The list of files is
        written last, so a search sees all of an update or nothing of it."""
        known = self._known()
        new = sorted(f for f in self._listed() if f not in known)
        if not new:
            return 0
        number = max(known.values(), default=-1) + 1
        # The name that a row's file has in the listing: its last parts.
        depth = new[0].count("/") + 1
        name = F.substring_index(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/", -depth)
        # Overlapping matches in one pass along the text.
        runs = F.regexp_extract_all(F.lower(self.column), F.lit("(?s)(?=(.{3}))"), F.lit(1))
        found = self._read(new).select(name.alias("file"), F.explode(F.array_distinct(runs)).alias("gram")).distinct()
        (
            found.withColumn("bucket", _bucket(F.col("gram"), self.buckets))
            .repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "gram", "file")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/grams/batch={number}")
        )
        self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/files/batch={number}")
        return len(new)

    def files(self, text: str) -> list[str] | None:
        """The files that may hold the text, in any letter case; None for all."""
        wanted = grams(text)
        if not wanted:
            return None
        listed, known = self._listed(), self._known()
        buckets = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(
            _bucket(F.col("gram"), self.buckets).alias("b")).distinct().collect()
        holding = (
            self._stored("grams", _POSTINGS)
            .filter(F.col("bucket").isin([r.b for r in buckets]) & F.col("gram").isin(wanted))
            .groupBy("file", "batch").agg(F.count_distinct("gram").alias("n"))
            .filter(F.col("n") == len(wanted))
        )
        # An update that was not finished does not count.
        held = {r.file for r in holding.collect() if known.get(r.file) == r.batch}
        return sorted(f for f in listed if f in held or f not in known)

    def search(self, contains: str, **conditions) -> DataFrame:
        """``search.search_logs`` over the table, opening only files that may hold
        the text."""
        if self.column != "message":
            raise ValueError("search_logs looks into message; use files() for other columns")
        files = self.files(contains)
        rows = self.spark.read.parquet(self.table) if files is None else self._read(files)
        return search.search_logs(rows, contains=contains, **conditions)
