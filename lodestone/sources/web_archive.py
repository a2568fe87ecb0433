"""Archived pages of short messages, in the old and the new layout, and the lists of their snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import keep
from lodestone.operators.htmltags import Node, tree
from lodestone.session import exists
from lodestone.sources.schema import IMAGE, MEDIA, PUBLIC, TWITTER, record

SNAPSHOTS = "array<struct<timestamp:string,url:string,original:string>>"
PARSED = "status string, text string, iso string, utime bigint, author string, images array<string>, quote_url string, reply_url string, reply_author string"


def snapshot_lists(handles: DataFrame, cache: str, search: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(handle, timestamp, url) of the snapshots of all `handles`: from the cache, or searched for and added to it.

    search() takes a handle without @ in lower case and returns stamps and URLs; it runs in the tasks, once for each handle that the cache doesn't have.
    A handle without snapshots is remembered too, one whose search fails is not. Only URLs of messages are kept.
    """
    spark = handles.sparkSession
    asked = handles.select(F.lower(F.regexp_replace(T.strip(F.col("handle")), "^@", "")).alias("handle")).where("handle <> ''").distinct()
    schema = "handle string, found boolean, timestamp string, url string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for handle in batch.handle:
                try:
                    hits = [h for h in search(handle) if "/status/" in h[1]]
                except OSError:  # what a network does; asked again next time
                    continue
                yield pd.DataFrame([(handle, True, *h) for h in hits] or [(handle, False, None, None)], columns=["handle", "found", "timestamp", "url"])

    known = spark.read.schema(schema).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], schema)
    new = asked.join(known.select("handle").distinct(), "handle", "left_anti").repartition("handle")
    new.mapInPandas(run, schema).write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache).join(asked, "handle", "left_semi").where("found").select("handle", "timestamp", "url")


def best_snapshots(snapshots: DataFrame) -> DataFrame:
    """(status, timestamp, url): of each message's snapshots (seq, timestamp, url) the newest, by its stamp as text; of equal ones the first."""
    rows = snapshots.where(F.col("url").contains("/status/")).withColumn("status", U.status_id(F.col("url"))).where("status is not null")
    return keep.newest(rows.select("status", "timestamp", "url", "seq"), ["status"], "timestamp", "seq").drop("seq")


def newest_messages(rows: DataFrame, most: int) -> DataFrame:
    """The `most` newest by their ids as numbers."""
    return rows.orderBy(F.desc_nulls_last(F.col("status").try_cast("decimal(38,0)")), "status").limit(most)


def parent_of(status: str, root_id: str, ancestors: list[Node]) -> Node | None:
    """Of the messages above: the latest that is older than this one, else the conversation's first, else the last one."""
    ids = [n.attrs.get("data-tweet-id", "") for n in ancestors]
    older = [(int(i), -k) for k, i in enumerate(ids) if status.isdecimal() and i.isdecimal() and 0 < int(i) < int(status)]
    if older:
        return ancestors[-max(older)[1]]
    if root_id and root_id in ids:
        return ancestors[ids.index(root_id)]
    return ancestors[-1] if ancestors else None


def old_layout(root: Node, status: str) -> dict | None:
    every = [n for n in root.all("div", "tweet") if n.attrs.get("data-tweet-id")]
    main = next((n for n in every if n.attrs["data-tweet-id"] == status), None)
    if not main:
        return None
    body, stamp = main.first("p", "tweet-text"), main.first("span", "_timestamp") or next((n for n in main.all("span") if n.attrs.get("data-time", "").isdigit()), None)
    quote = main.first("a", "QuoteTweet-link")
    out = {"text": body.text() if body else "", "utime": int(stamp.attrs["data-time"]) if stamp and stamp.attrs.get("data-time", "").isdigit() else None, "author": main.attrs.get("data-screen-name", ""), "images": [n.attrs["src"] for n in main.all("img") if "/media/" in n.attrs.get("src", "")], "quote_url": absolute(quote.attrs.get("href", "")) if quote else ""}
    root_id = main.attrs.get("data-conversation-id", "")
    if main.attrs.get("data-is-reply-to") == "true" or root_id not in ("", status):
        marked = [n for n in every if n is not main and "ancestor" in n.attrs.get("class", "").split()]
        # a page that marks no ancestors has its older messages instead
        parent = parent_of(status, root_id, marked or [n for n in every if n.attrs["data-tweet-id"].isdecimal() and status.isdecimal() and int(n.attrs["data-tweet-id"]) < int(status)])
        if parent and parent.attrs.get("data-tweet-id"):
            name = parent.attrs.get("data-screen-name", "")
            out |= {"reply_url": f"https://twitter.com/{name or 'i'}/status/{parent.attrs['data-tweet-id']}", "reply_author": name}
    return out


def absolute(href: str) -> str:
    return f"https://twitter.com{href}" if href.startswith("/") else href


def new_layout(root: Node, status: str) -> dict | None:
    articles = root.all("article", data_testid="tweet")
    here = [k for k, a in enumerate(articles) if any(f"/status/{status}" in n.attrs.get("href", "") for n in a.all("a"))]
    if not here:
        return None
    k = here[0]
    main, bodies = articles[k], articles[k].all("div", data_testid="tweetText")
    stamp, links = main.first("time"), [n.attrs.get("href", "") for n in main.all("a")]
    others = [h for h in links if "/status/" in h and f"/status/{status}" not in h]
    before = [n.attrs.get("href", "") for n in articles[k - 1].all("a") if "/status/" in n.attrs.get("href", "")] if k else []
    return {"text": bodies[0].text() if bodies else "", "iso": stamp.attrs.get("datetime") if stamp else None, "author": next((h.strip("/") for h in links if h.startswith("/") and "/" not in h[1:]), ""), "images": [n.attrs["src"] for n in main.all("img") if "/media/" in n.attrs.get("src", "")], "quote_url": absolute(others[0]) if len(bodies) > 1 and others else "", "reply_url": absolute(before[0]) if before else ""}


def message(html: str | None, status: str) -> dict:
    root = tree(html)
    found = old_layout(root, status) or new_layout(root, status) or {}
    return dict.fromkeys(("text", "iso", "utime", "author", "quote_url", "reply_url", "reply_author")) | {"images": []} | found | {"status": status}


def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        yield pd.DataFrame([message(html, status) for status, html in zip(batch.status, batch.html)], columns=names).astype({"utime": "Int64"})


def records(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of the newest snapshots; `pages` (status, html) need not have all. A quote goes before the message that is replied to."""
    best = best_snapshots(snapshots)
    parsed = best.select("status").join(pages, "status").mapInPandas(messages, PARSED)
    rows = best.join(parsed, "status", "left")
    at = F.coalesce(dates.iso(F.col("iso")), F.timestamp_seconds("utime"), dates.archive_stamp(F.col("timestamp")))
    url = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))
    shared = lambda link, author: F.struct(F.coalesce(F.nullif(author, F.lit("")), U.status_handle(link), F.lit("")).alias("author"), link.alias("url"), F.lit("").alias("content_text"))
    quote, reply = F.col("quote_url"), F.col("reply_url")
    replies = (F.coalesce(quote, F.lit("")) == "") & (F.coalesce(reply, F.lit("")) != "")
    extra = F.create_map(F.lit("wayback_source"), F.lit("archive.org"), F.lit("wayback_timestamp"), F.col("timestamp"))
    media = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x: F.struct(F.lit(IMAGE).alias("type"), x.alias("original_url"), F.lit("").alias("original_filename"), F.lit("").alias("local_path"), F.lit("").alias("caption"))).cast(MEDIA)
    return record(
        rows, source=F.lit(TWITTER), source_id=F.col("status"), source_url=url, created_at=at, content_text=F.coalesce("text", F.lit("")), visibility=F.lit(PUBLIC), media=media, tags=T.short_hashtags(F.coalesce("text", F.lit(""))),
        reshared_from=F.when(F.coalesce(quote, F.lit("")) != "", shared(quote, F.lit(""))).when(replies, shared(reply, F.coalesce("reply_author", F.lit("")))),
        extra=F.when(replies, F.map_concat(extra, F.create_map(F.lit("reply_context"), F.lit("true")))).otherwise(extra))
