"""Pages of a graph API that were saved as they came, put together again by their cursors.

A saved response is a URL and a body. A page names the next one by URL; a chain is what follows from a first page. Chains are
followed by doubling: each round joins every page with the one twice as far ahead, so chains of n pages take log2(n) joins, all
chains at once, wherever their pages are saved. Access tokens in URLs don't count.

Cases: a page that isn't saved ends its chain (see missing()); pages that name each other in a circle are read once; a page saved
twice is read once; an error that no rule allows raises, as does a body that is no JSON.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lodestone.session import cut
from lodestone.sources.graph import COMMENT, POST

# The error of profiles whose posts have no edge of their own; the fields of a page.
NO_POSTS_EDGE = 2069030
PAGE = "struct<data:array<string>,paging:struct<next:string>>"
BODY = f"struct<data:array<string>,paging:struct<next:string>,feed:{PAGE},error:struct<message:string,code:bigint,error_subcode:bigint>>"


def bare(url: Column) -> Column:
    """A URL without its access token."""
    return F.regexp_replace(F.regexp_replace(url, r"([?&])access_token=[^&#]*&?", "$1"), r"[?&]$", "")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of files of JSON lines with these two fields, the body as the API sent it."""
    return spark.read.text(path).select(F.from_json("value", "url string, body string").alias("r")).select("r.url", "r.body").where("url is not null")


def pages(responses: DataFrame) -> DataFrame:
    """(url, items, next, feed_items, feed_next, failed, subcode) of responses (url, body), each URL once."""
    body = F.from_json("body", BODY)
    rows = responses.groupBy(bare(F.col("url")).alias("url")).agg(F.max("body").alias("body")).withColumn("b", body)
    # a body with `feed` is read there, even if it is null; any other one has the page itself
    nested = F.coalesce(F.array_contains(F.json_object_keys("body"), "feed"), F.lit(False))
    link = lambda c: F.nullif(bare(F.col(c)), F.lit(""))
    none = F.array().cast("array<string>")
    feed_items, feed_next = F.when(nested, F.col("b.feed.data")).otherwise(F.col("b.data")), F.when(nested, link("b.feed.paging.next")).otherwise(link("b.paging.next"))
    failed = F.when(F.json_object_keys("body").isNull(), F.lit("no JSON")).when(F.col("b.error").isNotNull(), F.coalesce("b.error.message", F.lit("error")))
    return rows.select("url", F.coalesce("b.data", none).alias("items"), link("b.paging.next").alias("next"), F.coalesce(feed_items, none).alias("feed_items"), feed_next.alias("feed_next"), failed.alias("failed"), F.col("b.error.error_subcode").alias("subcode"))


def chained(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(key, url, place) of all pages in the chains from `starts` (key, url), by `links` (url, next); place counts from 0."""
    found = cut(starts.select("key", "url", F.lit(0).cast("long").alias("place")))
    jump = cut(links.where("next is not null").select("url", F.col("next").alias("to")).distinct())
    ahead, most = 1, jump.count() + 1
    while ahead <= most:
        more = found.join(jump, "url").select("key", F.col("to").alias("url"), (F.col("place") + ahead).alias("place"))
        # pages in a circle come again and again: each counts where it is met first
        grown = cut(found.union(more).groupBy("key", "url").agg(F.min("place").alias("place")))
        if grown.count() == found.count():
            break
        found, ahead = grown, 2 * ahead
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.url")).select(F.col("a.url").alias("url"), F.col("b.to").alias("to")).distinct())
    return found


def missing(saved: DataFrame, chain: DataFrame) -> DataFrame:
    """(key, url) of pages that a chain names and nobody has saved."""
    return chain.join(saved.select("url"), "url", "left_anti").select("key", "url")


def checked(failed: Column, allowed: Column, items: Column) -> Column:
    """The items of a page of a chain; a failed one has none if it is allowed to fail, and raises otherwise.

    The message needs the page's place, so that no page is looked at before it is known to be in a chain.
    """
    told = F.concat(F.lit("page "), F.col("place").cast("string"), F.lit(" of a chain: "), failed)
    return F.when(failed.isNull(), items).when(allowed, F.array().cast("array<string>")).otherwise(F.raise_error(told))


def posts(saved: DataFrame, starts: DataFrame) -> DataFrame:
    """(key, place, pos, item) of all posts of the profiles `starts` (key, posts_url, feed_url), in order.

    A profile whose first page says that it has no edge of posts is read by its feed, from `feed_url` on; a later page of a feed that says
    so ends it.
    """
    starts = starts.select("key", bare(F.col("posts_url")).alias("posts_url"), bare(F.col("feed_url")).alias("feed_url"))
    first = starts.join(saved.select(F.col("url").alias("posts_url"), "subcode"), "posts_url")
    first = cut(first.select("key", "posts_url", "feed_url", F.coalesce(F.col("subcode") == NO_POSTS_EDGE, F.lit(False)).alias("by_feed")))
    direct = chained(saved.select("url", "next"), first.where("not by_feed").select("key", F.col("posts_url").alias("url")))
    feed = chained(saved.select("url", F.col("feed_next").alias("next")), first.where("by_feed").select("key", F.col("feed_url").alias("url")))
    ends = (F.col("place") > 0) & F.coalesce(F.col("subcode") == NO_POSTS_EDGE, F.lit(False))
    read = direct.join(saved, "url").select("key", "place", checked(F.col("failed"), F.lit(False), F.col("items")).alias("items"))
    read = read.union(feed.join(saved, "url").select("key", "place", checked(F.col("failed"), ends, F.col("feed_items")).alias("items")))
    return read.select("key", "place", F.posexplode("items").alias("pos", "item"))


def comments(saved: DataFrame, found: DataFrame) -> DataFrame:
    """(key, post, comments) of posts (key, item): the comments in the post and on the pages after them.

    A post without any, unless it says that it has none, is asked for at its edge, <id>/comments; if a page there fails it has none.
    """
    block = "struct<id:string,comments:struct<data:array<string>,paging:struct<next:string>,summary:struct<total_count:bigint>>>"
    rows = found.select("key", F.from_json("item", block).alias("p")).select("key", F.col("p.id").alias("post"), F.coalesce("p.comments.data", F.array().cast("array<string>")).alias("own"), F.nullif(bare(F.col("p.comments.paging.next")), F.lit("")).alias("next"), F.col("p.comments.summary.total_count").alias("total"))
    rows = cut(rows.withColumn("key", F.struct("key", "post")))
    links = saved.select("url", "next")

    def gathered(starts: DataFrame, allowed: bool) -> DataFrame:
        """(key, more, broken) of the chains from `starts`."""
        read = chained(links, starts).join(saved, "url")
        items = checked(F.col("failed"), F.lit(allowed), F.col("items"))
        read = read.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", items.alias("items")))).alias("pages"), F.bool_or(F.col("failed").isNotNull()).alias("broken"))
        return read.select("key", F.flatten(F.transform("pages", lambda p: p["items"])).alias("more"), "broken")

    after = gathered(rows.where("next is not null").select("key", F.col("next").alias("url")), False)
    rows = rows.join(after.select("key", "more"), "key", "left").withColumn("comments", F.concat("own", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    rows = cut(rows)
    bare_ = rows.where((F.size("comments") == 0) & F.coalesce(F.col("post") != "", F.lit(False)) & ~F.coalesce(F.col("total") == 0, F.lit(False)))
    edge = gathered(bare_.select("key", F.concat("post", F.lit("/comments")).alias("url")), True).where("not broken")
    rows = rows.join(edge.select("key", "more"), "key", "left")
    return rows.select("key.key", "post", F.coalesce("more", "comments").alias("comments"))


def with_comments(found: DataFrame, said: DataFrame) -> DataFrame:
    """(p) of posts (key, item) with all comments that comments() found, for sources.graph.records()."""
    rows = found.select("key", F.from_json("item", POST).alias("p")).withColumn("post", F.col("p.id"))
    rows = rows.join(said, ["key", "post"], "left")
    full = F.transform("comments", lambda c: F.from_json(c, COMMENT))
    block = F.struct(full.alias("data"), F.col("p.comments.summary").alias("summary"))
    return rows.select(F.when(F.size("comments") > 0, F.col("p").withField("comments", block)).otherwise(F.col("p")).alias("p"))


def follow(fetch: Callable[[str], str], posts_url: str, feed_url: str) -> Iterator[tuple[str, str]]:
    """(url, body) of one profile's pages as fetch() gives them, by the same rules as posts()."""
    url, by_feed, met = posts_url, False, set()
    while url and url not in met:
        met.add(url)
        body = fetch(url)
        yield url, body
        page = json.loads(body)
        error = page.get("error")
        if error and error.get("error_subcode") == NO_POSTS_EDGE and not by_feed and len(met) == 1:
            url, by_feed = feed_url, True
        elif error:
            break
        else:
            block = (page["feed"] or {}) if by_feed and "feed" in page else page
            url = (block.get("paging") or {}).get("next")


def fetcher(options: dict) -> Callable[[str], str]:
    """The function that the option `fetch` names as module:function, called with the options."""
    module, name = options["fetch"].split(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Profile(InputPartition):
    posts_url: str
    feed_url: str


class GraphPages(DataSource):
    """Responses of an API that pages by cursor: a partition for each profile, which follows its chain alone.

    Options: `profiles`, JSON of [posts_url, feed_url] pairs; `fetch`, module:function of a function that takes the options and returns one
    from URL to body. As a stream its offset is the list of cursors: each batch is the next page of every chain that goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "graph_pages"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return GraphReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return GraphStream(dict(self.options))


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Profile(*pair) for pair in json.loads(self.options["profiles"])]

    def read(self, partition: Profile) -> Iterator[tuple]:
        yield from follow(fetcher(self.options), partition.posts_url, partition.feed_url)


class GraphStream(SimpleDataSourceStreamReader):
    """Its offset: for each profile the URL of its next page, whether its feed is read, and the feed's URL."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"open": [[posts, False, feed] for posts, feed in json.loads(self.options["profiles"])]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        fetch, rows, after = fetcher(self.options), [], []
        for url, by_feed, feed in start["open"]:
            turns = follow(fetch, url, feed if not by_feed else "")
            rows.append(next(turns))
            page = json.loads(rows[-1][1])
            if page.get("error", {}).get("error_subcode") == NO_POSTS_EDGE and feed and not by_feed:
                after.append([feed, True, ""])
            elif "error" not in page:
                block = (page["feed"] or {}) if by_feed and "feed" in page else page
                url = (block.get("paging") or {}).get("next")
                after += [[url, by_feed, ""]] if url else []
        return iter(rows), {"open": after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]
