"""Activity-log exports: posts and comments of a profile, with media, counts, links and names from side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import keep, links
from lodestone.sources.archives import json_rows, members
from lodestone.sources.schema import COMMENTS, FACEBOOK, LINK, MEDIA, PUBLIC, record

STAMP = "timestamp:struct<utime:bigint,iso:string,rawText:string>"
POSTS = f"struct<collectedAt:string,postsWithText:array<struct<postKey:string,fbId:string,url:string,{STAMP},text:string,reshareCommentary:string,reshared_from_url:string>>>"
SAID = f"struct<collectedAt:string,commentsWithText:array<struct<commentId:string,replyCommentId:string,fbId:string,url:string,{STAMP},text:string>>>"
MANIFEST = "array<struct<filename:string,originalUrl:string,sourcePermalink:string,context:string,skipped:boolean>>"
COUNTS, ATTACHED, NAMES = "map<string,bigint>", "map<string,array<struct<url:string,title:string,image:string>>>", "map<string,string>"


def exported(spark: SparkSession, path: str, name: str, schema: str, field: str, prefix: str) -> DataFrame:
    """(seq, collected, r): the rows of one member."""
    found = json_rows(members(spark, path, name), schema)
    return found.select(F.col("j.collectedAt").alias("collected"), "member", F.posexplode(f"j.{field}").alias("pos", "r")).withColumn("seq", F.concat_ws("/", F.lit(prefix), "member", F.lpad(F.col("pos").cast("string"), 12, "0")))


def time_of(r: str) -> F.Column:
    return dates.resolve(F.col(f"{r}.timestamp.utime"), F.col(f"{r}.timestamp.iso"), F.col(f"{r}.timestamp.rawText"), F.col("collected"))


def posts(raw: DataFrame) -> DataFrame:
    """(source_id, seq, url, text, at, reshare, commentary, target): rows that are posts; of one id the longest text, of equal ones the first."""
    url = F.coalesce(F.nullif("r.url", F.lit("")), "r.postKey", F.lit(""))
    text = T.clean_activity(F.col("r.text"))
    rows = raw.select("seq", url.alias("url"), text.alias("text"), time_of("r").alias("at"), F.col("r.timestamp.utime").alias("utime"), F.col("r.timestamp.rawText").alias("raw_time"), T.is_reshare(F.coalesce("r.text", F.lit(""))).alias("reshare"), T.clean_commentary(F.col("r.reshareCommentary")).alias("commentary"), F.coalesce("r.reshared_from_url", F.lit("")).alias("target"))
    rows = rows.where(~F.col("url").rlike("[?&]ref=notif|notif_t=") & (F.col("text") != ""))
    rows = rows.withColumn("source_id", U.activity_id(F.col("url"), F.col("utime"), F.col("raw_time"), F.col("text"))).drop("utime", "raw_time")
    ranked = keep.best(rows, ["source_id"], [F.length("text")])
    # of equal lengths the first: a second pass over the few that tie
    tied = rows.join(ranked.select("source_id", F.length("text").alias("most")), "source_id").where(F.length("text") == F.col("most")).drop("most")
    return keep.first(tied, ["source_id"], "seq")


def reshares(rows: DataFrame) -> DataFrame:
    """The state of every row and what it reshares; rows that others absorb are gone. See links.reshare_states."""
    own = keep.mode(rows.withColumn("segment", U.first_segment(F.col("url"))), "segment", "seq").select(F.col("segment").alias("own_segment"))
    rows = rows.withColumn("segment", U.first_segment(F.col("url"))).crossJoin(F.broadcast(own))  # one row
    states = links.reshare_states(rows.withColumn("id", F.col("source_id")).withColumn("own", F.col("segment") == F.col("own_segment")))
    others = rows.select(F.col("source_id").alias("other_id"), F.col("url").alias("other_url"), F.col("segment").alias("other_segment"))
    joined = states.join(others, "other_id", "left")
    state = F.col("state")
    author = F.when(state == 4, F.col("other_segment")).when(state == 5, U.first_segment(F.col("target"))).when(state == 7, F.col("segment")).otherwise("")
    url = F.when(state == 4, F.col("other_url")).when(state == 5, F.col("target")).when(state == 7, F.col("url")).otherwise("")
    body = F.when(state == 4, F.col("text")).when(state == 6, F.lit(links.MISSING)).otherwise("")
    made = F.struct(author.alias("author"), url.alias("url"), body.alias("content_text"))
    out = joined.where(~state.isin(3, 9)).withColumn("reshared_from", F.when(state.between(4, 7), made))
    return out.withColumn("text", F.when(state == 4, "").otherwise(F.col("text"))).withColumn("url", F.when(state == 7, "").otherwise(F.col("url"))).withColumn("has_media", ~state.between(4, 7))


def post_media(entries: DataFrame) -> DataFrame:
    """(source_id, media) of (source_id, seq, filename, url, is_reel): foreign images, sound tracks and, of a reel, pictures go.

    The last video variant goes first; an image whose path other posts have too belongs to none of them.
    """
    entries = entries.where(~F.col("url").rlike(U.FOREIGN_IMAGES)).withColumn("path", U.path(F.col("url")))
    entries = links.seen_once(entries, "source_id", "path")
    movie = F.col("filename").endswith(".mp4")
    variant = movie & F.col("url").rlike(U.VIDEO_VARIANT)
    entries = entries.where((movie | ~F.col("is_reel")) & ~(variant & U.is_audio_stream(F.col("url")))).withColumn("variant", variant)
    best = keep.last(entries.where("variant"), ["source_id"], "seq")
    kept = entries.where("not variant").unionByName(best)
    item = F.struct(F.when(F.col("filename").endswith(".mp4"), 2).otherwise(U.file_media_type(F.col("filename"))).alias("type"), F.col("url").alias("original_url"), F.col("filename").alias("original_filename"), F.lit("").alias("local_path"), F.lit("").alias("caption"))
    packed = kept.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct((~F.col("variant")).alias("later"), "seq", item.alias("m")))).alias("l"))
    return packed.select("source_id", F.transform("l", lambda x: x["m"]).cast(MEDIA).alias("media"))


def map_rows(found: DataFrame, schema: str, value: str) -> DataFrame:
    return json_rows(found, schema).where("j is not null").select(F.explode("j").alias("key", value))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of an activity-log export."""
    rows = reshares(posts(exported(spark, path, "*posts*.json", POSTS, "postsWithText", "p")))
    key = U.post_key(F.col("url"))
    by_key = rows.where("url <> ''").groupBy(key.alias("key")).agg(F.max_by("source_id", "seq").alias("source_id"))
    # comments of others' posts have no post here
    said = exported(spark, path, "*comments*.json", SAID, "commentsWithText", "c")
    said = said.select("seq", U.post_key(F.col("r.url")).alias("key"), U.comment_id(F.col("r.fbId"), F.col("r.commentId"), F.col("r.url")).alias("comment_id"), F.when(F.coalesce("r.replyCommentId", F.lit("")) != "", F.col("r.commentId")).otherwise("").alias("parent"), T.clean_activity(F.col("r.text")).alias("text"), time_of("r").alias("at"))
    comment = F.struct(F.lit("").alias("author"), F.lit("").alias("author_url"), "text", F.timestamp_seconds("at").alias("date"), F.col("comment_id").alias("source_id"), F.col("parent").alias("parent_comment_id"))
    placed = said.where("text <> ''").join(by_key, "key").groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", comment.alias("c")))).alias("l"))
    placed = placed.select("source_id", F.transform("l", lambda x: x["c"]).cast(COMMENTS).alias("comments"))
    manifest = json_rows(members(spark, path, "*media_manifest.json"), MANIFEST).select(F.posexplode("j").alias("seq", "m"))
    manifest = manifest.where("m.filename is not null and not coalesce(m.skipped, false)").select("seq", U.post_key(F.col("m.sourcePermalink")).alias("key"), F.col("m.filename").alias("filename"), F.col("m.originalUrl").alias("url"))
    reel = manifest.join(by_key, "key").join(rows.select("source_id", F.col("url").contains("/reel/").alias("is_reel"), "has_media"), "source_id").where("has_media")
    media = post_media(reel.select("source_id", "seq", "filename", "url", "is_reel"))
    counts = map_rows(members(spark, path, "*reaction_counts.json"), COUNTS, "reactions")
    attached = map_rows(members(spark, path, "*link_attachments.json"), ATTACHED, "cards")
    rows = rows.withColumn("post_key", key).join(placed, "source_id", "left").join(media, "source_id", "left")
    rows = links.by_first_key(rows, "source_id", [F.col("url"), F.col("post_key")], counts.where("reactions > 0"), "key", "reactions", "reactions")
    rows = links.by_first_key(rows, "source_id", [F.col("url")], attached, "key", "cards", "cards")
    card = F.get("cards", F.lit(0))
    card = F.array(F.struct(F.lit(LINK).alias("type"), card["url"].alias("original_url"), F.lit("").alias("original_filename"), F.lit("").alias("local_path"), card["title"].alias("caption"))).cast(MEDIA)
    media = F.coalesce("media", F.array().cast(MEDIA))
    extra = F.when(F.coalesce("reactions", F.lit(0)) > 0, F.create_map(F.lit("fb_reaction_total_count"), F.col("reactions").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return record(
        rows, source=F.lit(FACEBOOK), source_id=F.col("source_id"), source_url=F.col("url"), created_at=F.timestamp_seconds("at"), content_text=F.col("text"), visibility=F.lit(PUBLIC), reshared_from=F.col("reshared_from"),
        media=F.when((F.size(media) == 0) & (F.size("cards") > 0) & F.col("has_media"), card).otherwise(media), comments=F.coalesce("comments", F.array().cast(COMMENTS)), tags=T.short_hashtags(F.col("text")), extra=extra)


def summary(raw: DataFrame) -> DataFrame:
    """Counts of an export in one pass: rows, notices, empty texts, reshares."""
    text = T.clean_activity(F.col("r.text"))
    return raw.agg(F.count("*").alias("rows"), F.count_if(F.col("r.url").rlike("[?&]ref=notif|notif_t=")).alias("notices"), F.count_if(text == "").alias("empty"), F.count_if(T.is_reshare(F.coalesce("r.text", F.lit("")))).alias("reshares"))


def profile_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of the profiles that an export names."""
    return map_rows(members(spark, path, "*profile_links.json"), NAMES, "url").withColumnRenamed("key", "name")


def merge_months(parts: DataFrame, key: str) -> DataFrame:
    """Harvests of months as one: of a key's rows the last month's, with counts added and flags joined by or."""
    numbers = [c for c, kind in parts.dtypes if kind in ("int", "bigint", "double") and c not in (key, "month")]
    flags = [c for c, kind in parts.dtypes if kind == "boolean"]
    rest = [c for c in parts.columns if c not in (key, "month", *numbers, *flags)]
    return parts.groupBy(key).agg(*[F.max_by(c, "month").alias(c) for c in rest], *[F.sum(c).alias(c) for c in numbers], *[F.max(c).alias(c) for c in flags])
