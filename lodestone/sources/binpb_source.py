"""The record files of sources.binpb as a data source: spark.read.format("binpb"), df.write.format("binpb").

Reading: a file is cut into ranges of bytes, each a task. Records have no marks at their starts, so a task walks over lengths, four bytes
a record, from the last start that the file's index knows to the first one in its range, and reads the records that start there. The
index, written beside each file, has a start for about every INDEX bytes; without one the walk begins at the file's start.

Writing: a task writes a hidden file; the driver renames all of them once every task has told it of its own, and deletes them if one fails. A second
attempt of a task writes a file of its own, and only the one whose message arrives is renamed. The mode "overwrite" deletes earlier files after that.

For folders that driver and executors mount as a file system; for other stores there are binpb.read() and binpb.write(). Cases: a record that is cut short
or can't be read ends its range with a row whose `error` says so; the ranges after a broken length are empty; an empty file or folder has no rows.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.sources.binpb import fill, plain, record_class
from lodestone.sources.schema import FIELDS, RECORD

#: Bytes of a range, and between two starts of an index; records of a batch.
RANGE, INDEX, BATCH = 64 << 20, 1 << 20, 1000
SCHEMA = f"{RECORD}, file string, error string"


def folder_of(path: str) -> Path:
    """The path in the file system; another store's URL is refused."""
    plain_ = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in plain_:
        raise ValueError(f"{path} is no folder of a mounted file system: use lodestone.sources.binpb")
    return Path(plain_)


def index_of(file: Path) -> Path:
    return file.with_name(f"_{file.name}.starts")


def first_start(file: Path, low: int, size: int) -> int:
    """Where the first record at or behind byte `low` starts; the file's size if lengths lead nowhere there."""
    at = 0
    if low and index_of(file).exists():
        at = max((s for s in json.loads(index_of(file).read_text()) if s <= low), default=0)
    with open(file, "rb") as f:
        while at < low:
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                return size
            at += 4 + struct.unpack(">I", head)[0]
    return min(at, size)


def records(file: Path, low: int, high: int) -> Iterator[dict]:
    """The records that start in a range of bytes, and a row with `error` where one can't be read."""
    make, size = record_class(), file.stat().st_size
    at = first_start(file, low, size)
    with open(file, "rb") as f:
        f.seek(at)
        while at < min(high, size):
            head = f.read(4)
            length = struct.unpack(">I", head)[0] if len(head) == 4 else 0
            data = f.read(length) if at + 4 + length <= size else b""
            try:
                if len(head) < 4 or len(data) < length:
                    raise ValueError("a record is cut short")
                yield {**plain(make.FromString(data)), "file": str(file), "error": None}
            except Exception as e:  # whatever the bytes break, the range ends here and the row says so
                yield {"file": str(file), "error": str(e) or type(e).__name__}
                return
            at += 4 + length


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


class BinpbReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.bytes, self.schema = folder_of(options["path"]), int(options.get("rangebytes", RANGE)), schema

    def partitions(self) -> list[InputPartition]:
        files = [self.folder] if self.folder.is_file() else sorted(p for p in self.folder.rglob("*.binpb") if not p.name.startswith((".", "_")))
        ranges = [Range(str(p), low, low + self.bytes) for p in files for low in range(0, p.stat().st_size, self.bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        rows = records(Path(partition.file), partition.low, partition.high) if partition.file else iter(())
        while part := list(islice(rows, BATCH)):
            for row in part:
                row["extra"] = list((row.get("extra") or {}).items()) if row["error"] is None else None
            yield pa.RecordBatch.from_pylist(part, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str
    records: int


class BinpbWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = str(folder_of(options["path"])), overwrite, uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context, make = TaskContext.get(), record_class()
        name = f"part-{context.partitionId():05d}-{self.job}.binpb"
        os.makedirs(self.folder, exist_ok=True)
        temporary = f"{self.folder}/.{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        n, at, starts = 0, 0, [0]
        try:
            with open(temporary, "wb") as f:
                for batch in iterator:
                    for row in batch.select([c for c in FIELDS if c in batch.schema.names]).to_pylist():
                        message = make()
                        fill(message, row)
                        data = message.SerializeToString(deterministic=True)
                        if at - starts[-1] >= INDEX:
                            starts.append(at)
                        f.write(struct.pack(">I", len(data)) + data)
                        n, at = n + 1, at + 4 + len(data)
            Path(f"{temporary}.starts").write_text(json.dumps(starts))
        except BaseException:
            self.drop(temporary)
            raise
        return Written(temporary, name, n)

    def drop(self, temporary: str) -> None:
        for path in (temporary, f"{temporary}.starts"):
            Path(path).unlink(missing_ok=True)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Path(self.folder)
        folder.mkdir(parents=True, exist_ok=True)
        earlier = [p for p in folder.iterdir() if p.name.endswith((".binpb", ".binpb.starts"))] if self.overwrite else []
        for m in filter(None, messages):
            os.replace(f"{m.temporary}.starts", index_of(folder / m.name))
            os.replace(m.temporary, folder / m.name)
        for path in earlier:
            path.unlink()
        self.clean()
        (folder / "_SUCCESS").touch()

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            self.drop(m.temporary)
        self.clean()

    def clean(self) -> None:
        """Deletes what attempts left that were lost with their executor or came second."""
        if os.path.isdir(self.folder):
            for path in Path(self.folder).glob(f".{self.job}-*"):
                path.unlink(missing_ok=True)


class BinpbSource(DataSource):
    """Options: path; rangeBytes, the bytes of a task when reading."""

    @classmethod
    def name(cls) -> str:
        return "binpb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinpbReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> BinpbWriter:
        return BinpbWriter(dict(self.options), overwrite)
