"""Files of length-delimited records: a big-endian length of four bytes, then a record in protobuf's wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.schema import FIELDS, RECORD

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# Field numbers are places in these lists, as in the record's schema.
MESSAGES = {
    "Comment": ["author s", "author_url s", "text s", "date t", "source_id s", "parent_comment_id s"],
    "Location": ["name s", "lat d", "lng d"],
    "MediaItem": ["type i", "original_url s", "original_filename s", "local_path s", "caption s"],
    "Reaction": ["type i", "user s", "user_url s"],
    "ResharedFrom": ["author s", "url s", "content_text s"],
    "PostRecord": ["source i", "source_id s", "source_url s", "created_at t", "updated_at t", "title s", "content_text s", "content_html s", "visibility i", "location Location", "reshared_from ResharedFrom", "media MediaItem*", "reactions Reaction*", "comments Comment*", "tags s*", "extra map"],
}


@lru_cache(1)
def record_class():
    """The message class, built from MESSAGES; enums travel as their numbers."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory, timestamp_pb2

    D = descriptor_pb2.FieldDescriptorProto
    pool = descriptor_pool.DescriptorPool()
    pool.AddSerializedFile(timestamp_pb2.DESCRIPTOR.serialized_pb)
    file = descriptor_pb2.FileDescriptorProto(name="posts.proto", syntax="proto3", dependency=["google/protobuf/timestamp.proto"])
    kinds = {"s": D.TYPE_STRING, "i": D.TYPE_INT32, "d": D.TYPE_DOUBLE}
    for name, fields in MESSAGES.items():
        message = file.message_type.add(name=name)
        for number, field in enumerate(fields, 1):
            key, kind = field.split()
            many, kind = kind.endswith("*"), kind.rstrip("*")
            made = message.field.add(name=key, number=number, label=D.LABEL_REPEATED if many or kind == "map" else D.LABEL_OPTIONAL)
            if kind in kinds:
                made.type = kinds[kind]
            else:
                made.type, made.type_name = D.TYPE_MESSAGE, {"t": ".google.protobuf.Timestamp", "map": ".PostRecord.ExtraEntry"}.get(kind, f".{kind}")
        if name == "PostRecord":
            entry = message.nested_type.add(name="ExtraEntry")
            entry.options.map_entry = True
            for number, key in enumerate(("key", "value"), 1):
                entry.field.add(name=key, number=number, label=D.LABEL_OPTIONAL, type=D.TYPE_STRING)
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("PostRecord"))


def fill(message, row) -> None:
    for field in message.DESCRIPTOR.fields:
        value = row.get(field.name) if isinstance(row, dict) else row[field.name]
        if value is None:
            continue
        if field.name == "extra":
            message.extra.update(value if isinstance(value, dict) else dict(value))
        elif field.message_type and field.message_type.name == "Timestamp":
            if not pd.isna(value):
                micros = int(pd.Timestamp(value).tz_localize("UTC").value if pd.Timestamp(value).tz is None else pd.Timestamp(value).value) // 1000
                getattr(message, field.name).FromMicroseconds(micros)
        elif field.message_type and field.is_repeated:
            for item in value:
                fill(getattr(message, field.name).add(), item)
        elif field.message_type:
            getattr(message, field.name).SetInParent()
            fill(getattr(message, field.name), value)
        elif field.is_repeated:
            getattr(message, field.name).extend(value)
        else:
            setattr(message, field.name, value)


def plain(message) -> dict:
    """A message as a row; an unset time is null."""
    out = {}
    for field in message.DESCRIPTOR.fields:
        value = getattr(message, field.name)
        if field.name == "extra":
            out[field.name] = dict(value)
        elif field.message_type and field.message_type.name == "Timestamp":
            out[field.name] = EPOCH + timedelta(microseconds=value.ToMicroseconds()) if message.HasField(field.name) else None
        elif field.message_type and field.is_repeated:
            out[field.name] = [plain(x) for x in value]
        elif field.message_type:
            out[field.name] = plain(value) if message.HasField(field.name) else None
        else:
            out[field.name] = list(value) if field.is_repeated else value
    return out


def split(data: bytes) -> Iterator[bytes]:
    """The records of a file; one that is cut short ends it."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            raise ValueError("a record is cut short")
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    make = record_class()
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            message = make()
            fill(message, row)
            data = message.SerializeToString(deterministic=True)
            out.append(struct.pack(">I", len(data)) + data)
        yield pd.DataFrame({"value": out})


def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records until the first that can't be read; that adds one row with `error`."""
    make, names = record_class(), list(FIELDS)

    def rows() -> Iterator[dict]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                try:
                    for data in split(content):
                        yield {**plain(make.FromString(data)), "file": path, "error": None}
                except Exception as e:  # whatever the bytes break, the file ends here and the row says so
                    yield dict.fromkeys(names) | {"file": path, "error": str(e) or type(e).__name__}

    found = rows()
    while part := list(islice(found, 1000)):
        yield pd.DataFrame(part, columns=[*names, "file", "error"]).astype({"source": "Int32", "visibility": "Int32"})


def write(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """One file for each part of the records, of `per_file` records about. Spark commits files as parquet of one binary column;
    export() makes plain files of them where the target is a file system that Python opens."""
    parts = records.select(*FIELDS).mapInPandas(encode, "value binary")
    parts.write.option("maxRecordsPerFile", per_file).parquet(path)


def export(path: str, folder: str) -> None:
    """The written records as plain .binpb files in a folder that every executor sees: each task writes its own."""
    import os

    spark = SparkSession.getActiveSession()

    def save(rows) -> None:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        temporary = f"{folder}/.{k}-{TaskContext.get().taskAttemptId()}"
        with open(temporary, "wb") as f:
            for row in rows:
                f.write(row.value)
        os.replace(temporary, f"{folder}/{k:05d}.binpb")  # a second attempt replaces the first

    os.makedirs(folder, exist_ok=True)
    spark.read.parquet(path).foreachPartition(save)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .binpb files below `path`, with file and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.binpb").load(path)
    return files.select("path", "content").mapInPandas(decode, f"{RECORD}, file string, error string")


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote."""
    parts = spark.read.parquet(path).select(F.lit(path).alias("path"), F.col("value").alias("content"))
    return parts.mapInPandas(decode, f"{RECORD}, file string, error string").drop("file", "error")


def schema() -> StructType:
    return StructType.fromDDL(RECORD)
