"""Folders of captured datagrams as a data source of Spark, for tables and for streams."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from driftcast.operators.datagrams import parse

#: A captured datagram: its size, the time of its arrival in seconds, its bytes.
_HEAD = ">Id"
SUFFIX = ".capture"


def write_captures(df: DataFrame, folder: str, time: str = "time", data: str = "data") -> DataFrame:
    """file, datagrams: a capture for each task, written under its attempt's name and renamed, so that a reader sees whole files."""
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        mine, name, n = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}", f"{task.partitionId():06d}{SUFFIX}", 0
        with fs.open_output_stream(mine) as out:
            for b in batches:
                for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out.write(struct.pack(_HEAD, len(d), t) + d)
                    n += 1
        fs.move(mine, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "datagrams": [n]})

    return df.select(F.col(time).cast("double"), F.col(data).cast("binary")).filter(F.col(data).isNotNull() & F.col(time).isNotNull()).mapInArrow(run, "file string, datagrams long")


def captured(data: bytes) -> Iterator[tuple[float, bytes]]:
    """Time and bytes of each datagram; one that is cut short ends a capture."""
    at, head = 0, struct.calcsize(_HEAD)
    while at + head <= len(data):
        size, time = struct.unpack_from(_HEAD, data, at)
        at += head
        if at + size > len(data):
            return
        yield time, data[at:at + size]
        at += size


@dataclass
class Capture(InputPartition):
    """One file of a folder."""

    path: str
    name: str


def _rows(folder: str, part: Capture) -> Iterator[tuple]:
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{part.name}") as src:
        data = src.read()
    for k, (time, body) in enumerate(captured(data)):
        for address, value in parse(body):
            yield part.name, k, time, address, value


def _names(folder: str) -> list[str]:
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("."))


class _Table(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Capture]:
        return [Capture(self.folder, n) for n in _names(self.folder)]

    def read(self, partition: Capture | None) -> Iterator[tuple]:
        return _rows(self.folder, partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is the last file's name; names of later captures must be greater."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_names(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[Capture]:
        return [Capture(self.folder, n) for n in _names(self.folder) if start["file"] < n <= end["file"]]

    def read(self, partition: Capture) -> Iterator[tuple]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class Datagrams(DataSource):
    """spark.read.format("datagrams").load(folder): a row for each control message of the captured bundles.

    Register it with spark.dataSource.register(Datagrams). A partition is a file; a datagram that is no bundle gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "file string, place int, time double, address string, value int"

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])
