"""A table whose files hold ranges of a key, so that a merge reads and writes again only the files that may hold a key it changes.

A version is a manifest: a row for each file with its slot, its least and largest key and its rows. Slots are ranges of the key: a key belongs to the slot
with the largest start that isn't above it, so slots never overlap, whatever is inserted. A merge reads the slots of its changes, writes
them under new names, and its manifest last; readers of earlier versions keep their files. A slot that grows is cut into more files, whose
starts are slots from then on.

A task writes A_TASK files in the order of keys, so what the driver hears of tasks and samples of keys doesn't grow with every file.

Cases: rows without a key are in the first slot; a key that repeats may be in the last rows of one file and the first ones of the next, which are then read together; a merge without changes adds a version of the
same files; a table may be empty. A manifest has at most FILES files; larger tables need fewer, larger files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut, exists
from lodestone.streaming.snapshots import versions

#: Rows of a file; files of a table, whose starts go with the tasks; files that a task writes.
PER_FILE, FILES, A_TASK = 1_000_000, 100_000, 32


@dataclass
class Merged:
    """What a merge did: the table's files before it, those it wrote again, and those that they became."""

    version: int
    files: int
    read: int
    written: int


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(file, low, high, rows) of a version, of the last one if none is asked for."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {'' if version is None else version} in {folder}")
    return spark.read.parquet(f"{folder}/manifest/version={known[-1] if version is None else version}")


def files_of(rows: DataFrame) -> list:
    """The manifest's rows by their starts."""
    found = rows.limit(FILES + 1).collect()
    if len(found) > FILES:
        raise ValueError(f"more than {FILES} files")
    return sorted(found, key=lambda r: (r.low is not None, r.low))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return _of_files(spark, folder, files_of(manifest(spark, folder, version)))


def _of_files(spark: SparkSession, folder: str, files: list) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/empty").schema
    return spark.read.schema(schema).parquet(*[r.file for r in files]) if files else spark.createDataFrame([], schema)


def _put(rows: DataFrame, folder: str, version: int, slot: Column, key: str, per_file: int) -> DataFrame:
    """(file, low, high, rows) of the files that `rows` are written to, each of `per_file` rows at most; no file has rows of two slots."""
    path = f"{folder}/files/version={version}"
    rows = cut(rows.withColumn("__slot", slot))
    tasks = max(1, -(-rows.count() // (per_file * A_TASK)))
    rows.repartitionByRange(tasks, "__slot", key).sortWithinPartitions("__slot", key).write.partitionBy("__slot").option("maxRecordsPerFile", per_file).mode("overwrite").parquet(path)
    if not exists(rows.sparkSession, path):
        return rows.limit(0).select(F.lit("").alias("file"), F.col(key).alias("low"), F.col(key).alias("high"), F.lit(0).cast("long").alias("rows"))
    back = rows.sparkSession.read.schema(rows.drop("__slot").schema).parquet(path)
    return back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))


def _commit(rows: DataFrame, folder: str, version: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")


def create(rows: DataFrame, folder: str, key: str, per_file: int = PER_FILE) -> None:
    """Version 0 of a table of `rows` by `key`, a text or a whole number."""
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/empty")
    _commit(_put(rows, folder, 0, F.lit(0), key, per_file), folder, 0)


def slot_of(starts: list) -> Callable[[Column], Column]:
    """The slot of a key: the last of the sorted starts that isn't above it."""
    held = np.array(starts, dtype=object)

    def find(keys: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), dtype=np.int32)
        some = keys.notna().to_numpy()
        if len(held) and some.any():
            out[some] = np.maximum(np.searchsorted(held, keys[some].to_numpy(dtype=object), side="right") - 1, 0)
        return pd.Series(out)

    return F.pandas_udf(find, "int")


def merge(spark: SparkSession, folder: str, key: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], per_file: int = PER_FILE) -> Merged:
    """The next version: apply(old, changes) on the slots that may hold a key of `changes`. It may change, drop and add rows of these keys only."""
    version = versions(spark, folder)[-1]
    files = files_of(manifest(spark, folder, version))
    starts = sorted({r.low for r in files if r.low is not None})
    slot = slot_of(starts)
    changes = cut(changes)
    touched = {r.slot for r in changes.select(slot(F.col(key)).alias("slot")).distinct().collect()}  # at most a row for each file
    number = {start: k for k, start in enumerate(starts)}
    # a key that repeats over files is the start of its slot, whose files share that start; the file before them may end with it
    changed = lambda r: number.get(r.low, 0) in touched or number.get(r.high, 0) in touched and r.high in number
    hit = [r for r in files if changed(r)]
    rest = [r for r in files if not changed(r)]
    new = cut(_put(apply(_of_files(spark, folder, hit), changes), folder, version + 1, slot(F.col(key)), key, per_file))
    kept = spark.createDataFrame([tuple(r) for r in rest], new.schema)
    _commit(kept.unionByName(new), folder, version + 1)
    return Merged(version + 1, len(files), len(hit), new.count())
