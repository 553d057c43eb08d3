"""An event channel as a data source: streams and batches are written to it and read from it, each event once.

A channel is a folder. Every write, a batch or a stream's micro-batch, leaves files of its tasks and then a version: a file that
names them and how many events they hold. An offset is a number of versions, so a reader that restarts at the offset in its
checkpoint replays what it has not finished and nothing else, and files of failed writes are in no version. A stream
that repeats a micro-batch finds that its ``writer`` has committed it and adds nothing. Versions are read in partitions, one for
each file. One writer commits at a time; folders are reached through pyarrow's file systems, on the driver and on executors.

    spark.dataSource.register(Channel)
    events.write.format("channel").option("path", uri).mode("append").save()
    spark.readStream.format("channel").option("path", uri).load()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: What an event is: the room it is for, its sender and kind, its text, and when it was sent.
EVENT = "room string, sender string, kind string, content string, sent timestamp"
_ARROW = pa.schema([("room", pa.string()), ("sender", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("sent", pa.timestamp("us", tz="UTC"))])
_ROWS = 10_000


class _Folder:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.files, self.path = fs.FileSystem.from_uri(self.uri)

    def names(self) -> list[str]:
        there = self.files.get_file_info(fs.FileSelector(f"{self.path}/versions", allow_not_found=True))
        return sorted(x.base_name for x in there if x.base_name.endswith(".json"))

    def version(self, number: int) -> dict:
        with self.files.open_input_stream(f"{self.path}/versions/{number:012d}.json") as source:
            return json.loads(source.read())

    def commit(self, messages: list[Written | None], writer: str | None = None, batch: int | None = None) -> None:
        names = self.names()
        if writer is not None and any(v.get("writer") == writer and v.get("batch") == batch for v in map(self.version, range(len(names), 0, -1))):
            return  # a micro-batch that was committed before the stream could note it
        body = json.dumps({"files": [m.name for m in messages if m and m.name], "n": sum(m.n for m in messages if m), "writer": writer, "batch": batch})
        self.files.create_dir(f"{self.path}/versions", recursive=True)
        made = f"{self.path}/versions/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(made) as out:
            out.write(body.encode())
        self.files.move(made, f"{self.path}/versions/{len(names) + 1:012d}.json")

    def put(self, rows: Iterator) -> Written:
        """Writes a task's events; of a task without events there is no file."""
        name, n, out = f"events-{uuid.uuid4().hex}.parquet", 0, None
        held: list[dict] = []

        def flush():
            nonlocal out, n
            if out is None:
                self.files.create_dir(f"{self.path}/events", recursive=True)
                out = pq.ParquetWriter(f"{self.path}/events/{name}", _ARROW, filesystem=self.files)
            out.write_batch(pa.RecordBatch.from_pylist(held, _ARROW))
            n += len(held)
            held.clear()

        for row in rows:
            held.append(row.asDict())
            if len(held) >= _ROWS:
                flush()
        if held:
            flush()
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, n)

    def drop(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                self.files.delete_file(f"{self.path}/events/{m.name}")

    def read(self, name: str) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(f"{self.path}/events/{name}") as source:
            yield from pq.ParquetFile(source).iter_batches(_ROWS)

    def files_of(self, start: int, end: int) -> list[InputPartition]:
        return [InputPartition(name) for v in range(start + 1, end + 1) for name in self.version(v)["files"]]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    n: int


class _Batch(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        folder = _Folder(self.uri)
        return folder.files_of(0, len(folder.names())) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from _Folder(self.uri).read(partition.value)


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": len(_Folder(self.uri).names())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _Folder(self.uri).files_of(start["version"], end["version"]) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from _Folder(self.uri).read(partition.value)

    def commit(self, end: dict) -> None:
        pass


class _BatchWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator) -> Written:
        return _Folder(self.uri).put(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _Folder(self.uri).commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        _Folder(self.uri).drop(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, uri: str, writer: str):
        self.uri, self.writer = uri, writer

    def write(self, iterator: Iterator) -> Written:
        return _Folder(self.uri).put(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.uri).commit(messages, self.writer, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.uri).drop(messages)


class Channel(DataSource):
    """Options: path, the channel's folder; writer, the name under which a stream writes (each its own)."""

    @classmethod
    def name(cls) -> str:
        return "channel"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("events are added to a channel; use mode append")
        return _BatchWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], self.options["writer"])
