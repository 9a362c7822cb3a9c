"""State messages as files, each epoch of a stream exactly once: a Python data source for ``writeStream``.

Tasks write their messages to a staging folder; when all have, the driver lists their files in
the epoch's manifest, one file that appears whole or not at all.  What no manifest lists was
never written.  An epoch that runs again after a failure finds its manifest and leaves its
files out, or finds none and is written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as files
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "state_messages"


@dataclass
class Staged(WriterCommitMessage):
    """One task's file and its number of messages."""

    name: str
    rows: int


class MessageWriter(DataSourceStreamWriter):
    """``path`` is a folder that driver and executors share; ``column`` holds the messages."""

    def __init__(self, path: str, column: str = "message"):
        self.path, self.column = path, column

    def _at(self, *parts: str) -> tuple[files.FileSystem, str]:
        store, root = files.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (files.LocalFileSystem(), self.path)
        return store, "/".join((root.rstrip("/"), *parts))

    def _manifest(self, epoch: int) -> tuple[files.FileSystem, str]:
        return self._at("manifests", f"{epoch:012d}.json")

    def write(self, iterator: Iterator[Row]) -> Staged:
        name, rows = f"{uuid.uuid4().hex}.json", 0
        store, folder = self._at("messages")
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write(row[self.column].encode() + b"\n")
                rows += 1
        return Staged(name, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, path = self._manifest(batchId)
        if store.get_file_info(path).type == files.FileType.File:
            self.abort(messages, batchId)  # this epoch was committed before the query stopped
            return
        store.create_dir(self._at("manifests")[1], recursive=True)
        kept = [m for m in messages if m is not None and m.rows]
        with store.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps({"epoch": batchId, "files": [m.name for m in kept], "rows": sum(m.rows for m in kept)}).encode())
        store.move(f"{path}.part", path)
        self.abort([m for m in messages if m is not None and not m.rows], batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in messages:
            if m is not None:
                store, path = self._at("messages", m.name)
                if store.get_file_info(path).type == files.FileType.File:
                    store.delete_file(path)


class MessageFiles(DataSource):
    """``df.writeStream.format("state_messages").option("path", folder)``; the messages are in ``column``, by default "message"."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "message string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> MessageWriter:
        column = self.options.get("column", "message")
        if column not in schema.names:
            raise ValueError(f"no column {column} to write")
        return MessageWriter(self.options["path"], column)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageFiles)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(message): all messages of committed epochs."""
    writer = MessageWriter(path)
    store, folder = writer._at("manifests")
    found = store.get_file_info(files.FileSelector(folder, allow_not_found=True))
    names = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as manifest:
                names += json.loads(manifest.read())["files"]
    if not names:
        return spark.createDataFrame([], "message string")
    return spark.read.text([f"{path.rstrip('/')}/messages/{n}" for n in names]).withColumnRenamed("value", "message")
