"""A streaming source over log files that are still being written.

Spark's own file source takes a file as finished once it has seen it. This one
keeps a byte offset per file, which Spark stores in the query's checkpoint with
the file's number, and reads only whole lines. A file of the same name but
another number is a new one; a renamed one is found by its number. The directory must be on a file system that the
driver and all executors share.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, source_file string"
#: Lines of one Arrow batch.
BATCH = 8192


def _batch(values: list[str], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, pa.string()), pa.array([name] * len(values), pa.string())], ["value", "source_file"])


class Span(InputPartition):
    """The lines of one file that begin in ``[start, stop)``."""

    def __init__(self, name: str, inode: int, start: int, stop: int):
        super().__init__((name, inode, start, stop))
        self.name, self.inode, self.start, self.stop = name, inode, start, stop


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(directory)``

    Options: ``suffix`` (``.log``), ``splitBytes`` (64 MiB): a larger piece of
    one file is read by several tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "LogTailReader":
        return LogTailReader(self.options)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.directory = options["path"].removeprefix("file:")
        self.suffix = options.get("suffix", ".log")
        self.split = int(options.get("splitBytes", 64 * 1024 * 1024))
        self.known: dict[str, list[int]] = {}  # name -> inode, offset

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        there = {}
        with os.scandir(self.directory) as entries:
            for entry in entries:
                try:
                    if not (entry.name.endswith(self.suffix) and entry.is_file()):
                        continue
                    found = os.stat(entry.path)
                    inode, done = self.known.get(entry.name, (found.st_ino, 0))
                    # Another file of the name, or one that shrank, begins anew.
                    if inode != found.st_ino or found.st_size < done:
                        done = 0
                    if found.st_size > done:
                        done = last_line_end(entry.path, done, found.st_size)
                    there[entry.name] = [found.st_ino, done]
                except FileNotFoundError:  # rotated away in between
                    continue
        self.known = there  # files that are gone need no offset
        return {"files": json.dumps(there, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or after
        spans = []
        for name, (inode, stop) in after.items():
            same, begin = before.get(name, (inode, 0))
            begin = 0 if same != inode or stop < begin else begin
            for at in range(begin, stop, self.split):
                spans.append(Span(name, inode, at, min(at + self.split, stop)))
        return spans

    def _open(self, span: Span):
        """The file of the span, also if rotation has renamed it since; None if
        it is gone."""
        names = [span.name, *sorted(os.listdir(self.directory))]
        for name in names:
            try:
                file = open(os.path.join(self.directory, name), "rb")
            except (FileNotFoundError, IsADirectoryError):
                continue
            if os.fstat(file.fileno()).st_ino == span.inode:
                return file
            file.close()
        return None

    def read(self, partition: Span):
        file = self._open(partition)
        if file is None:
            return
        with file:
            at = partition.start
            if at > 0:
                # A line that began in the piece before belongs to it.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            values: list[str] = []
            while at < partition.stop:
                line = file.readline()
                if not line:
                    break
                at += len(line)
                values.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(values) == BATCH:
                    yield _batch(values, partition.name)
                    values = []
            if values:
                yield _batch(values, partition.name)

    def commit(self, end: dict) -> None:
        pass


def last_line_end(path: str, start: int, size: int, block: int = 65536) -> int:
    """Offset after the last line break in ``[start, size)``, else ``start``."""
    with open(path, "rb") as file:
        stop = size
        while stop > start:
            begin = max(start, stop - block)
            file.seek(begin)
            found = file.read(stop - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
    return start
