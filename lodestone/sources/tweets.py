"""Exports of short messages: own posts, replies in own threads and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import keep
from lodestone.sources.activity import ATTACHED, COUNTS, MANIFEST, map_rows
from lodestone.sources.archives import json_rows, members
from lodestone.sources.schema import LINK, MEDIA, PUBLIC, TWITTER, record

EXPORT = """struct<ownerHandle:string,collectedAt:string,postsWithText:array<struct<tweetId:string,fbId:string,url:string,postKey:string,text:string,author:string,authorHandle:string,
  timestamp:struct<iso:string,utime:bigint,rawText:string>,likeCount:bigint,retweetCount:bigint,replyCount:bigint,resharedFrom:struct<author:string,authorHandle:string,url:string>,
  quotedTweet:struct<url:string,author:string,authorHandle:string,text:string>,inReplyTo:struct<statusId:string,screenName:string,url:string>,isReply:boolean,replyToHandle:string>>>"""


def handle(c) -> F.Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^@+", ""))


def raw(spark: SparkSession, path: str) -> DataFrame:
    """(phase, seq, r, given): both phases in one frame; posts come before replies."""
    parts = []
    for phase, name in ((0, "*posts.json"), (1, "*comments.json")):
        found = json_rows(members(spark, path, name), EXPORT)
        parts.append(found.select(F.lit(phase).alias("phase"), F.col("j.ownerHandle").alias("given"), F.posexplode("j.postsWithText").alias("pos", "r")))
    rows = parts[0].unionByName(parts[1])
    return rows.withColumn("seq", F.col("phase") * F.lit(10**12) + F.col("pos")).withColumn("author", handle(F.col("r.authorHandle")))


def owner(rows: DataFrame) -> DataFrame:
    """(owner): the handle that the export gives, else the most frequent one among posts, else among replies."""
    given = rows.where("coalesce(given, '') <> ''").select(handle(F.col("given")).alias("owner"), F.lit(0).alias("rank"))
    counted = [keep.mode(rows.where(F.col("phase") == k), "author", "seq").select(F.col("author").alias("owner"), F.lit(k + 1).alias("rank")) for k in (0, 1)]
    return given.limit(1).unionByName(counted[0]).unionByName(counted[1]).orderBy("rank").limit(1).select("owner")


def own(rows: DataFrame) -> DataFrame:
    """What the owner wrote: no others' posts, replies to others (unless quotes) or plain reposts."""
    rows = rows.crossJoin(F.broadcast(owner(rows)))  # one row
    repost, quote = F.col("r.resharedFrom").isNotNull(), F.col("r.quotedTweet").isNotNull()
    target = F.coalesce(F.nullif(handle(F.col("r.inReplyTo.screenName")), F.lit("")), handle(F.col("r.replyToHandle")))
    foreign = (F.col("author") != "") & (F.col("author") != F.col("owner")) & ~repost
    elsewhere = (target != "") & (target != F.col("owner")) & ~repost & ~quote
    return rows.where(~foreign & ~elsewhere & ~(repost & ~quote))


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = own(raw(spark, path))
    url = F.coalesce(F.nullif("r.url", F.lit("")), "r.postKey", F.lit(""))
    rows = rows.select("seq", "r", url.alias("url"), T.strip(F.coalesce("r.text", F.lit(""))).alias("text")).withColumn("source_id", U.tweet_id(F.col("r.tweetId"), F.col("r.fbId"), F.col("url")))
    rows = keep.longest(rows, ["source_id"], "text", "seq")
    quoted = F.col("r.quotedTweet")
    at_handle = F.concat(F.lit("@"), U.status_handle(quoted["url"]))
    author = F.coalesce(F.nullif(quoted["author"], F.lit("")), F.nullif(quoted["authorHandle"], F.lit("")), at_handle, F.lit(""))
    reshared = F.when(quoted.isNotNull(), F.struct(author.alias("author"), F.coalesce(quoted["url"], F.lit("")).alias("url"), F.coalesce(quoted["text"], F.lit("")).alias("content_text")))
    at = F.coalesce(F.unix_seconds(dates.iso(F.col("r.timestamp.iso"))), F.when(F.col("r.timestamp.utime") > 0, dates.epoch_seconds(F.col("r.timestamp.utime"))))
    counts = map_rows(members(spark, path, "*reaction_counts.json"), COUNTS, "counted").groupBy("key").agg(F.max("counted").alias("counted"))
    cards = map_rows(members(spark, path, "*link_attachments.json"), ATTACHED, "cards").groupBy("key").agg(F.first("cards").alias("cards"))
    media = json_rows(members(spark, path, "*media_manifest.json"), MANIFEST).select(F.posexplode("j").alias("pos", "m"))
    item = F.struct(U.media_type(F.col("m.originalUrl")).alias("type"), F.col("m.originalUrl").alias("original_url"), F.coalesce("m.filename", F.lit("")).alias("original_filename"), F.lit("").alias("local_path"), F.lit("").alias("caption"))
    media = media.groupBy(F.col("m.sourcePermalink").alias("key")).agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("m")))).alias("l")).select("key", F.transform("l", lambda x: x["m"]).cast(MEDIA).alias("media"))
    for side in (counts, cards, media):
        rows = rows.join(side.withColumnRenamed("key", "url"), "url", "left")
    # here a link's card keeps its image as URL
    links = F.transform(F.filter(F.coalesce("cards", F.array().cast("array<struct<url:string,title:string,image:string>>")), lambda c: F.coalesce(c["url"], F.lit("")) != ""), lambda c: F.struct(F.lit(LINK).alias("type"), c["image"].alias("original_url"), F.lit("").alias("original_filename"), F.lit("").alias("local_path"), c["title"].alias("caption"))).cast(MEDIA)
    likes = F.greatest(F.coalesce("r.likeCount", F.lit(0)), F.coalesce("counted", F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("tw_like_count", likes), ("tw_retweet_count", F.coalesce("r.retweetCount", F.lit(0))), ("tw_reply_count", F.coalesce("r.replyCount", F.lit(0))))])
    extra = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["v"] > 0), lambda p: F.struct(p["k"], p["v"].cast("string"))))
    return record(rows, source=F.lit(TWITTER), source_id=F.col("source_id"), source_url=F.col("url"), created_at=F.timestamp_seconds(at), content_text=F.col("text"), visibility=F.lit(PUBLIC), reshared_from=reshared, media=F.concat(F.coalesce("media", F.array().cast(MEDIA)), links), tags=T.short_hashtags(F.col("text")), extra=extra)
