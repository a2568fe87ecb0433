"""A sink of numbered snapshots of keyed rows: each batch writes the keys it changes, and its manifest last.

A snapshot is a base and the changes after it; the manifest of a version names both. Only complete manifests count, so a batch that breaks off leaves nothing, and
one that is replayed after its manifest is there changes nothing. Every `fold` batches the base is written anew. Any version can be
read until vacuum() drops it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 10
MANIFEST = "version bigint, base bigint, changes array<bigint>"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete snapshots' numbers, ascending."""
    system, at = _hadoop(spark, f"{folder}/manifest/version=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in system.globStatus(at) or [])


def manifest(spark: SparkSession, folder: str, version: int):
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={version}").first()


def _parts(spark: SparkSession, folder: str, row) -> DataFrame | None:
    """The base's and the changes' rows with the number of their batch, -1 for the base."""
    paths = ([(f"{folder}/base/version={row.base}", -1)] if row.base >= 0 else []) + [(f"{folder}/changes/batch={n}", n) for n in row.changes]
    parts = [spark.read.parquet(p).withColumn("__batch", F.lit(n).cast("long")) for p, n in paths]
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last")).select(*keys, "__last.*")


def read(spark: SparkSession, folder: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The rows of a snapshot, each key's latest; of the last complete one if no version is asked for."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"no snapshot {'' if version is None else version} in {folder}")
    return _latest(_parts(spark, folder, manifest(spark, folder, known[-1] if version is None else version)), keys)


def sink(folder: str, keys: list[str], fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batches in update mode, each key once in a batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, folder)
        if number in known:
            return
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        before = manifest(spark, folder, known[-1]) if known else None
        base, changes = (before.base, [*before.changes, number]) if before else (-1, [number])
        if len(changes) > fold:
            row = spark.createDataFrame([(number, base, changes)], MANIFEST).first()
            _latest(_parts(spark, folder, row), keys).write.mode("overwrite").parquet(f"{folder}/base/version={number}")
            base, changes = number, []
        spark.createDataFrame([(number, base, changes)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")

    return write


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Deletes all but the last `keep` snapshots, and the bases and changes that none of these names."""
    known = versions(spark, folder)
    kept = [manifest(spark, folder, v) for v in known[-keep:]]
    # manifests go first: what they name may then be deleted
    names = {"manifest": [f"version={r.version}" for r in kept], "base": [f"version={r.base}" for r in kept], "changes": [f"batch={n}" for r in kept for n in r.changes]}
    for part, wanted in names.items():
        system, at = _hadoop(spark, f"{folder}/{part}/*=*")
        for status in system.globStatus(at) or []:
            if status.getPath().getName() not in wanted:
                system.delete(status.getPath(), True)
