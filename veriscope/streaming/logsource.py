"""Log files as a stream source whose offsets are bytes of each file, so that lines keep the order of their file."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, seq bigint, value string"
#: Bytes of a file that one task reads at most; a stretch ends with the line that reaches it.
STRETCH = 64 << 20


@dataclass
class Stretch(InputPartition):
    """Bytes [begin, end) of a file; a line belongs to the stretch in which it begins."""

    path: str
    begin: int
    end: int


def _whole_lines(path: str) -> int:
    """Bytes of a file up to its last line feed: a line that is still being written is not there yet."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end:
            begin = max(0, end - 65536)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def _files(folder: str, suffix: str) -> dict[str, int]:
    names = sorted(n for n in os.listdir(folder) if n.endswith(suffix)) if os.path.isdir(folder) else []
    return {n: _whole_lines(os.path.join(folder, n)) for n in names}


def _stretches(folder: str, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
    return [Stretch(os.path.join(folder, n), a, min(a + STRETCH, b)) for n, b in sorted(end.items()) for a in range(start.get(n, 0), b, STRETCH)]


def _lines(stretch: Stretch) -> Iterator[tuple[str, int, str]]:
    """(file, offset of the line's first byte, line)."""
    name = os.path.basename(stretch.path)
    with open(stretch.path, "rb") as file:
        at = stretch.begin
        if at:
            file.seek(at - 1)
            at += len(file.readline()) - 1  # the rest of a line that began before
        while at < stretch.end:
            line = file.readline()
            yield name, at, line.rstrip(b"\r\n").decode(errors="replace")
            at += len(line)


class _Stream(DataSourceStreamReader):
    """Offsets are JSON of bytes by file; a file that grew is read on from where it was, a new one from its start."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(_files(self.folder, self.suffix), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return _stretches(self.folder, json.loads(start["files"]), json.loads(end["files"])) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _lines(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        """Nothing to release: the files stay."""


class _Batch(DataSourceReader):
    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[Stretch]:
        return _stretches(self.folder, {}, _files(self.folder, self.suffix)) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return _lines(partition) if partition.path else iter(())


class RunLogs(DataSource):
    """Lines (file, seq, value) of the files of a folder that all nodes see; options ``path`` and ``suffix`` (``.log``)."""

    @classmethod
    def name(cls) -> str:
        return "run_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"].removeprefix("file://"), self.options.get("suffix", ".log"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"].removeprefix("file://"), self.options.get("suffix", ".log"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunLogs)
