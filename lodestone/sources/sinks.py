"""What an archive gives out: feeds, sitemap shards, snapshots, profile links and media."""

from __future__ import annotations

import os
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def feed_items(rows: DataFrame, base: str) -> DataFrame:
    """(created_at, id, item) of (id, title, description, created_at): RSS items."""
    link = F.concat(F.lit(f"{base}/post/"), F.col("id").cast("string"), F.lit("/"))
    body = F.concat(tag("title", xml(F.col("title"))), tag("link", link), tag("guid", link), tag("description", xml(F.col("description"))), tag("pubDate", F.coalesce(F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit(""))))
    return rows.select("created_at", "id", tag("item", body).alias("item"))


def feed(items: DataFrame, title: str, base: str) -> str:
    """The feed of a bounded list of items, newest first."""
    rows = items.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(20).collect()
    return f'<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>{title}</title><link>{base}</link>{"".join(r["item"] for r in rows)}</channel></rss>'


def write_sitemap(rows: DataFrame, path: str, base: str, per_file: int = 50_000) -> None:
    """URLs of (id, created_at) as text, a folder for each year, files of `per_file` URLs at most. Undated posts have no shard."""
    url = F.concat(F.lit("<url>"), tag("loc", F.concat(F.lit(f"{base}/post/"), F.col("id").cast("string"), F.lit("/"))), tag("lastmod", F.date_format("created_at", "yyyy-MM-dd")), F.lit("</url>"))
    rows.where("created_at is not null").select(F.year("created_at").alias("year"), url.alias("value")).write.partitionBy("year").option("maxRecordsPerFile", per_file).mode("overwrite").text(path)


def write_snapshot(rows: DataFrame, path: str, source: str | None = None) -> None:
    """The table by source; with `source` that one's rows alone are replaced."""
    writer = rows.write.partitionBy("source").mode("overwrite").option("partitionOverwriteMode", "dynamic" if source else "static")
    writer.parquet(path)


def write_profile_links(names: DataFrame, path: str) -> None:
    """Names and their URLs (name, url) as one JSON object, in one text file, by name; of a name that repeats the least URL."""
    rows = names.where("name is not null and url is not null").groupBy("name").agg(F.min("url").alias("url"))
    text = F.regexp_extract(F.to_json(F.create_map("name", "url")), r"(?s)^\{(.*)\}$", 1)
    least = F.broadcast(rows.agg(F.min("name").alias("least")))  # one row
    lines = rows.join(least, F.lit(True)).select(F.lit(1).alias("part"), "name", F.concat(F.when(F.col("name") == F.col("least"), "").otherwise(","), text).alias("value"))
    spark = names.sparkSession
    ends = spark.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, name string, value string")
    # sorted by all tasks, then written by one as it streams by: the format is one file
    lines.unionByName(ends).orderBy("part", "name").select("value").coalesce(1).write.mode("overwrite").text(path)


def copy_media(files: DataFrame, folder: str) -> DataFrame:
    """(name, local_path, copied) of `files` (name, content, created_at): each is put into media/<year>/<month> below `folder` unless it is there.

    `folder` is mounted on all executors. A file appears under its name only when it is whole, and the first one stays.
    """

    def put(batches):
        for batch in batches:
            done = []
            for where, name, content in zip(batch["at"], batch["name"], batch["content"]):
                target = os.path.join(folder, "media", where, name)
                new = not os.path.exists(target)
                if new:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    temporary = os.path.join(os.path.dirname(target), f".{uuid4().hex}")
                    with open(temporary, "wb") as f:
                        f.write(content)
                    try:
                        os.link(temporary, target)
                    except FileExistsError:
                        new = False
                    os.unlink(temporary)
                done.append((name, f"media/{where}/{name}", new))
            yield pd.DataFrame(done, columns=["name", "local_path", "copied"])

    base = F.regexp_extract("name", r"([^/\\]+)$", 1)
    rows = files.where(base != "").select(F.coalesce(F.date_format("created_at", "yyyy/MM"), F.lit("unknown")).alias("at"), base.alias("name"), "content")
    return rows.mapInPandas(put, "name string, local_path string, copied boolean")
