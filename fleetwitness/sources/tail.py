"""Log files that still grow: a streaming source with a byte offset per file.

A micro-batch takes, of every file, the bytes from where the last one ended up to the last line
break; an unfinished last line is held back until its break is written. Offsets are the only state
and live in the stream's checkpoint, so a restarted stream goes on at the byte where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetwitness.sources.logs import parse_log_line
from fleetwitness.streaming.drain import use_state_store

SCHEMA = "file STRING, byte_off BIGINT, text STRING"
#: A file's new bytes are read by tasks of about this size.
RANGE_BYTES = 32 << 20
LOOK_BACK = 1 << 16
BATCH_LINES = 10_000


@dataclass
class LineRange(InputPartition):
    """Lines that start in ``start <= offset < stop``; ``start`` is a line's start if ``whole``."""

    file: str
    start: int
    stop: int
    end: int
    whole: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def complete_bytes(store: fs.FileSystem, file: str, start: int, size: int) -> int:
    """The offset behind the last line break between ``start`` and ``size``; ``start`` if there is none."""
    with store.open_input_file(file) as source:
        at = size
        while at > start:
            low = max(start, at - LOOK_BACK)
            source.seek(low)
            found = source.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, root = opened(self.path)
        ends: dict[str, int] = {}
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            before = self.known.get(info.path, 0)
            # A file that became shorter was started anew.
            before = 0 if info.size < before else before
            ends[info.path] = before if info.size == before else complete_bytes(store, info.path, before, info.size)
        self.known = ends
        return {"files": json.dumps(ends)}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **self.known}
        out = []
        for file, stop in after.items():
            first = before.get(file, 0)
            first = 0 if stop < first else first
            for at in range(first, stop, self.range_bytes):
                out.append(LineRange(file, at, min(at + self.range_bytes, stop), stop, at == first))
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        schema = pa.schema([("file", pa.string()), ("byte_off", pa.int64()), ("text", pa.string())])
        with store.open_input_file(partition.file) as raw:
            raw.seek(partition.start if partition.whole else partition.start - 1)
            at, rest, offsets, texts = raw.tell(), b"", [], []
            skip = not partition.whole
            while at < partition.stop:
                more = raw.read(min(1 << 20, partition.end - at - len(rest)))
                if not more:
                    break
                lines = (rest + more).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.stop:
                        break
                    if not skip:
                        offsets.append(at)
                        texts.append(line.decode("utf-8", "replace"))
                    skip = False
                    at += len(line) + 1
                if len(texts) >= BATCH_LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(texts)), pa.array(offsets), pa.array(texts)], schema=schema)
                    offsets, texts = [], []
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(texts)), pa.array(offsets), pa.array(texts)], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", folder)``; option ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def tail_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """R1: whole lines of growing files, as a stream: ``file, byte_off, text``.

    ``path`` is a folder that driver and executors reach, as a path or a URI of a store that Arrow
    reads (file, hdfs, s3, gs). A line without its break is held back; a file that became shorter is
    read from its start again. Files starting with a dot or an underscore are left out. Text that is
    not UTF-8 gets replacement characters. The offsets name every file of the folder once, so rolled
    files that are read should be moved away.
    """
    use_state_store(spark)
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("range_bytes", range_bytes).load()


def tail_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same, cut into stamp, level, message, token and pairs."""
    return parse_log_line(tail_lines(spark, path))
