"""HTML posts of a takeout, one file each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators.htmltags import Node, tree
from lodestone.sources.archives import file_stem
from lodestone.sources.schema import COMMENTS, FRIENDS, GIF, GOOGLE_PLUS, IMAGE, LINK, MEDIA, PRIVATE, PUBLIC, REACTION, RESHARED, VIDEO, record

DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
RAW = f"path string, date_text string, source_url string, updated_text string, seen string, content_text string, has_reshare boolean, reshared {RESHARED}, media {MEDIA}, reactions {REACTION}, said array<struct<author:string,author_url:string,text:string,date_text:string>>, error string"


def name_of(path: str) -> str:
    return unquote(path.split("?")[0]).rsplit("/", 1)[-1]


def media_of(root: Node) -> list[dict]:
    out = []
    item = lambda kind, url="", file="", caption="": out.append({"type": kind, "original_url": url, "original_filename": file, "local_path": "", "caption": caption})
    for link in root.all(cls="media-link"):
        href, video, image = link.attrs.get("href", ""), link.first(cls="video-placeholder"), link.first("img")
        if video:
            title = video.attrs.get("title", "")
            web = href.startswith("http")
            item(VIDEO, href if web else "", "" if web else name_of(href), "" if title.lower() == "video" else title)
        elif image:
            src, alt = image.attrs.get("src", ""), image.attrs.get("alt", "")
            web = src.startswith("http")
            item(GIF if unquote(src).lower().endswith(".gif") else IMAGE, src if web else "", "" if web else name_of(src), "" if alt == "Image" else alt)
    for embed in root.all(cls="link-embed"):
        a = embed if embed.tag == "a" else embed.first("a")
        title = embed.first("h3") or embed.first(cls="link-embed-title")
        item(LINK, a.attrs.get("href", "") if a else "", "", title.text("") if title else "")
    return out


def comments_of(root: Node) -> list[dict]:
    below, out = root.first(cls="comments"), []
    for node in below.all(cls="comment") if below else []:
        author = node.first(cls="author") or node.first("a")
        body = node.first(cls="comment-content") or node.first(cls="comment-body") or node.first("p")
        stamp = next((m.group(1) for s in node.strings() if (m := re.search(r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}.*)", s))), "")
        out.append({"author": author.text("") if author else "", "author_url": author.attrs.get("href", "") if author else "", "text": body.text() if body else "", "date_text": stamp.strip()})
    return out


def sibling_after(node: Node) -> Node | None:
    around = [c for c in node.parent.children if isinstance(c, Node)]
    at = around.index(node)
    return around[at + 1] if at + 1 < len(around) else None


def parsed(path: str, html: str) -> dict:
    root = tree(html)
    dated = next((a for a in root.all("a") if DAY.search(a.text(""))), None)
    updated = next((m.group(1) for s in root.strings() if (m := re.search(r"Updated:\s*(\S+\s+\S+)", s))), None)
    seen, content, reshare = root.first(cls="visibility"), root.first(cls="main-content"), root.first(cls="reshare-attribution")
    text, link = content.text() if content else "", reshare.first("a") if reshare else None
    if reshare and not text and (after := sibling_after(reshare)):
        text = after.text()
    thanks = root.first(cls="plus-oners")
    return {
        "path": path, "date_text": dated.text("") if dated else None, "source_url": dated.attrs.get("href", "") if dated else "", "updated_text": updated, "seen": seen.text(" ") if seen else "", "content_text": text,
        "has_reshare": reshare is not None, "reshared": {"author": link.text("") if link else "", "url": link.attrs.get("href", "") if link else "", "content_text": ""}, "media": media_of(root),
        "reactions": [{"type": 1, "user": a.text(""), "user_url": a.attrs.get("href", "")} for a in thanks.all("a")] if thanks else [], "said": comments_of(root), "error": None,
    }


def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "date_text", "source_url", "updated_text", "seen", "content_text", "has_reshare", "reshared", "media", "reactions", "said", "error"]
    for batch in batches:
        rows = []
        for path, html in zip(batch.path, batch.html):
            try:
                rows.append(parsed(path, html))
            except (ValueError, AssertionError) as e:  # what the parser refuses is reported as a row
                rows.append(dict.fromkeys(names) | {"path": path, "error": str(e)})
        yield pd.DataFrame(rows, columns=names)


def records(files: DataFrame) -> DataFrame:
    """Records of (path, html). A date that the page lacks is that of the file's name; pages that can't be parsed are left out."""
    rows = files.mapInPandas(pages, RAW).where("error is null").withColumn("stem", file_stem(F.col("path")))
    seen = F.lower("seen")
    visibility = F.when((seen == "") | seen.contains("public"), PUBLIC).when(seen.rlike("extended|circles|friends"), FRIENDS).otherwise(PRIVATE)
    by_name = F.try_to_timestamp(F.regexp_extract("stem", r"^(\d{8})", 1), F.lit("yyyyMMdd"))
    said = F.transform("said", lambda c: F.struct(c["author"], c["author_url"], c["text"], dates.takeout(c["date_text"]).alias("date"), F.lit("").alias("source_id"), F.lit("").alias("parent_comment_id"))).cast(COMMENTS)
    media = F.transform("media", lambda m: m.withField("original_url", F.when(m["type"] == VIDEO, U.video_link(m["original_url"])).otherwise(m["original_url"])))
    return record(
        rows, source=F.lit(GOOGLE_PLUS), source_id=F.col("stem"), source_url=F.col("source_url"), created_at=F.coalesce(dates.takeout(F.col("date_text")), by_name), updated_at=dates.takeout(F.col("updated_text")),
        content_text=F.col("content_text"), visibility=visibility, reshared_from=F.when(F.col("has_reshare"), F.col("reshared")), media=media, reactions=F.col("reactions"), comments=said, tags=F.array_distinct(T.hashtags(F.col("content_text"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return records(files.select(F.url_decode("_metadata.file_path").alias("path"), F.col("value").alias("html")))
