"""A network's JSON archive: posts, their attachments, and own comments that are put below the post they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import asof
from lodestone.sources.archives import json_rows, members
from lodestone.sources.schema import COMMENTS, FACEBOOK, LINK, MEDIA, PUBLIC, record

ATTACHMENT = """struct<media:struct<uri:string,title:string,description:string>,external_context:struct<url:string>,
  place:struct<name:string,coordinate:struct<latitude:double,longitude:double>>>"""
POSTS = f"array<struct<timestamp:bigint,title:string,data:array<struct<post:string,update_timestamp:bigint>>,attachments:array<struct<data:array<{ATTACHMENT}>>>,tags:array<struct<name:string>>>>"
COMMENTED = "struct<comments_v2:array<struct<timestamp:bigint,title:string,data:array<struct<comment:struct<timestamp:bigint,comment:string,author:string>>>>>>"
THREAD_S, POST_S = 72 * 3600, 7 * 86_400


def raw_posts(spark, path: str) -> DataFrame:
    """(seq, p): the archive's posts in order of file and place."""
    found = json_rows(members(spark, path, "*your_posts__check_ins__photos_and_videos*.json"), POSTS)
    return found.where("j is not null").select("member", F.posexplode("j").alias("pos", "p")).withColumn("seq", F.struct("member", "pos"))


def own_posts(raw: DataFrame, memories: bool = False, market: bool = False, comments: bool = False) -> DataFrame:
    """Records of posts. Memories, sales and comments go unless asked for; so do posts with neither text, media nor place."""
    kind = T.title_kind(T.archive_text(F.col("p.title")))
    drop = F.lit(False)
    for kinds, wanted in ((("memory",), memories), (("market", "fundraiser"), market), (("self_reply", "self_direct", "external"), comments)):
        drop = drop if wanted else drop | kind.isin(*kinds)
    rows = raw.where(~drop).withColumn("at", F.coalesce("p.timestamp", F.lit(0)))
    # several posts of one second get _2, _3; those that are dropped as empty below have taken their number
    k = F.row_number().over(Window.partitionBy("at").orderBy("seq"))
    name = F.col("at").cast("string")
    rows = rows.withColumn("source_id", F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
    texts = F.filter(F.transform(F.coalesce("p.data", F.array()), lambda d: d["post"]), lambda x: x.isNotNull())
    edits = F.filter(F.transform(F.coalesce("p.data", F.array()), lambda d: d["update_timestamp"]), lambda x: x > 0)
    text = T.archive_text(F.get(texts, F.size(texts) - 1))
    parts = F.flatten(F.transform(F.coalesce("p.attachments", F.array()), lambda a: F.coalesce(a["data"], F.array())))
    clean = T.archive_text

    def item(d):
        uri = F.coalesce(d["media"]["uri"], F.lit(""))
        caption = F.coalesce(F.nullif(clean(d["media"]["description"]), F.lit("")), clean(d["media"]["title"]))
        file = F.regexp_extract(uri, r"([^/]+)$", 1)
        made = F.struct(U.file_media_type(uri).alias("type"), F.lit("").alias("original_url"), file.alias("original_filename"), F.lit("").alias("local_path"), caption.alias("caption"))
        link = F.struct(F.lit(LINK).alias("type"), d["external_context"]["url"].alias("original_url"), F.lit("").alias("original_filename"), F.lit("").alias("local_path"), F.lit("").alias("caption"))
        return F.when(d["media"].isNotNull(), made).when(F.coalesce(d["external_context"]["url"], F.lit("")) != "", link)

    media = F.filter(F.transform(parts, item), lambda x: x.isNotNull()).cast(MEDIA)
    place = F.get(F.filter(F.transform(parts, lambda d: d["place"]), lambda x: x.isNotNull()), 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    location = F.when(place.isNotNull(), F.struct(clean(place["name"]).alias("name"), zero(place["coordinate"]["latitude"]).alias("lat"), zero(place["coordinate"]["longitude"]).alias("lng")))
    people = F.filter(F.transform(F.coalesce("p.tags", F.array()), lambda t: clean(t["name"])), lambda x: x != "")
    rows = rows.withColumn("text", text).withColumn("media", media).withColumn("location", location)
    rows = rows.where((F.col("text") != "") | (F.size("media") > 0) | F.col("location").isNotNull())
    tags = F.concat(people, F.array_except(T.hashtags(F.col("text")), people))
    return rows.select(
        "seq", "at",
        F.struct(*[c.alias(n) for n, c in {
            "source_id": F.col("source_id"), "created_at": F.when(F.col("at") > 0, F.timestamp_seconds("at")), "updated_at": F.timestamp_seconds(F.get(edits, F.size(edits) - 1)),
            "content_text": F.col("text"), "media": F.col("media"), "location": F.col("location"), "tags": tags}.items()]).alias("r"))


def self_comments(spark, path: str) -> DataFrame:
    """(at, author, text) of comments on own posts, and of replies in threads that such a comment began.

    A reply counts if the latest comment before it, at most 72 hours ago, that began a thread was on an own post.
    """
    found = json_rows(members(spark, path, "*comments_and_reactions/comments.json"), COMMENTED)
    rows = found.select(F.posexplode("j.comments_v2").alias("pos", "c")).select(
        "pos", F.coalesce("c.timestamp", F.lit(0)).alias("at"), T.title_kind(T.archive_text(F.col("c.title"))).alias("kind"), F.get(F.col("c.data"), 0)["comment"].alias("said"), F.lit(0).alias("one"))
    anchors = rows.where("kind in ('self_direct', 'external')").select("one", "at", "pos", (F.col("kind") == "self_direct").alias("own"))
    replies = rows.where("kind = 'self_reply'")
    replies = asof.latest_before(replies, anchors, "one", "at", "pos", ["own"], THREAD_S, strict=True).where("own").drop("own", "gap")
    kept = rows.where("kind = 'self_direct'").unionByName(replies)
    text = T.archive_text(F.col("said.comment"))
    at = F.when(F.col("at") > 0, F.col("at")).otherwise(F.coalesce("said.timestamp", F.lit(0)))
    return kept.select("pos", at.alias("at"), T.archive_text(F.col("said.author")).alias("author"), text.alias("text")).where("text <> ''")


def read(spark, path: str, **flags: bool) -> DataFrame:
    """Records of an archive, ZIP or folder, with own comments below the latest post at or before them, at most seven days ago."""
    posts = own_posts(raw_posts(spark, path), **flags)
    made = posts.select(F.lit(0).alias("one"), "at", "seq", F.col("r.source_id").alias("source_id"))
    placed = asof.latest_before(self_comments(spark, path).withColumn("one", F.lit(0)), made, "one", "at", "seq", ["source_id"], POST_S, strict=False)
    comment = F.struct(F.col("author"), F.lit("").alias("author_url"), "text", F.when(F.col("at") > 0, F.timestamp_seconds("at")).alias("date"), F.lit("").alias("source_id"), F.lit("").alias("parent_comment_id"))
    placed = placed.where("source_id is not null").groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("at", "pos", comment.alias("c")))).alias("l"))
    placed = placed.select("source_id", F.transform("l", lambda x: x["c"]).cast(COMMENTS).alias("comments"))
    rows = posts.select("r.*").join(placed, "source_id", "left")
    return record(rows, source=F.lit(FACEBOOK), visibility=F.lit(PUBLIC), **{c: F.col(c) for c in ("source_id", "created_at", "updated_at", "content_text", "media", "location", "tags")}, comments=F.coalesce("comments", F.array().cast(COMMENTS)))
