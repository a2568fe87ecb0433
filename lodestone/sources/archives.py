"""Members of ZIP archives or of folders with the same layout, as rows (member, content)."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_members(patterns: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if any(fnmatch.fnmatch(name, p) for p in patterns):
                            yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)]})

    return run


def members(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """(archive, member, content) of what matches, in archives if `path` ends in .zip, else in the folder. Nothing that matches: no rows."""
    if path.endswith(".zip"):
        found = spark.read.format("binaryFile").load(path).select("path", "content")
        return found.mapInPandas(zip_members(patterns), "archive string, member string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    member = F.regexp_replace("path", f"^.*?{path.rstrip('/').rsplit('/', 1)[-1]}/", "")
    keep = F.lit(False)
    for p in patterns:
        keep = keep | member.rlike(fnmatch.translate(p).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$"))
    return found.where(keep).select(F.lit(path).alias("archive"), member.alias("member"), "content")


def json_rows(found: DataFrame, schema: str) -> DataFrame:
    """(archive, member, j): a member's JSON by an explicit schema; null where it isn't of that kind."""
    return found.select("archive", "member", F.from_json(F.col("content").cast("string"), schema).alias("j"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
