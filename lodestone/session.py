"""Sessions, tables and the folders that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every session of our own sets; a cluster's own settings for memory, executors and checkpoints come on top.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
    return builder.config(map=SETTINGS).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. On one machine alone a temporary one does where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return jsc.getCheckpointDir().get()


def apart(key: str) -> Column:
    """A text as it is, which Spark doesn't know to be the same: rows that are summed by it and then joined on it are dealt out
    twice, and the join, having an exchange of its own on both sides, can split a key with most rows."""
    return F.concat(F.col(key), F.lit("")).alias(key)


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
