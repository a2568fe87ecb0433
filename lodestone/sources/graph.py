"""Posts as a graph API pages them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions import text as T
from lodestone.sources.schema import COMMENTS, FACEBOOK, FRIENDS, IMAGE, LINK, MEDIA, PRIVATE, PUBLIC, REACTION, REACTIONS, VIDEO, record

# Who sees a post.
PRIVACY = {"EVERYONE": PUBLIC, "ALL_FRIENDS": FRIENDS, "FRIENDS_OF_FRIENDS": FRIENDS, "SELF": PRIVATE, "CUSTOM": PRIVATE}
PART = "type:string,url:string,title:string,description:string,media:struct<image:struct<src:string>,source:string>,target:struct<id:string>"
COMMENT = "struct<id:string,message:string,from:struct<name:string>,created_time:string,parent:struct<id:string>>"
SAID = f"struct<data:array<{COMMENT}>,summary:struct<total_count:bigint>>"
POST = f"""struct<id:string,message:string,story:string,created_time:string,updated_time:string,permalink_url:string,privacy:struct<value:string>,
  place:struct<name:string,location:struct<latitude:double,longitude:double>>,attachments:struct<data:array<struct<{PART},subattachments:struct<data:array<struct<{PART}>>>>>>,
  comments:{SAID},reactions:struct<data:array<struct<type:string,name:string>>,summary:struct<total_count:bigint>>>"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(p) of saved pages, JSON documents with `data`."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.explode(F.from_json("value", f"struct<data:array<{POST}>>")["data"]).alias("p"))


def blank(c) -> F.Column:
    return F.coalesce(c, F.lit(""))


def records(rows: DataFrame) -> DataFrame:
    """Records of posts (p); one without text, media and place is dropped, and so is a reshare that repeats the post's own text."""
    part = f"struct<{PART}>"
    top = F.coalesce("p.attachments.data", F.array().cast(f"array<struct<{PART},subattachments:struct<data:array<{part}>>>>"))
    own = lambda a: F.struct(*[a[k].alias(k) for k in ("type", "url", "title", "description", "media", "target")])
    subs = lambda a: F.coalesce(a["subattachments"]["data"], F.array().cast(f"array<{part}>"))
    flat = F.flatten(F.transform(top, lambda a: F.concat(F.array(own(a)), subs(a))))
    shown = F.flatten(F.transform(top, lambda a: F.when(F.size(subs(a)) > 0, subs(a)).otherwise(F.array(own(a)))))
    text = F.coalesce(F.nullif("p.message", F.lit("")), "p.story", F.lit(""))

    def item(a):
        source, image = blank(a["media"]["source"]), blank(a["media"]["image"]["src"])
        kind = F.when(a["type"].contains("video"), VIDEO).when(image != "", IMAGE).otherwise(LINK)
        kind = F.when((a["type"] == "share") & (blank(a["url"]) != ""), LINK).otherwise(kind)
        url = F.when(kind == LINK, blank(a["url"])).when((kind == VIDEO) & (source != ""), source).otherwise(F.when(image != "", image).otherwise(blank(a["url"])))
        return F.struct(kind.alias("type"), url.alias("original_url"), F.lit("").alias("original_filename"), F.lit("").alias("local_path"), F.coalesce(F.nullif(a["description"], F.lit("")), F.nullif(a["title"], F.lit("")), F.lit("")).alias("caption"))

    media = F.filter(F.transform(F.filter(shown, lambda a: a["type"] != "native_templates"), item), lambda m: m["original_url"] != "").cast(MEDIA)
    first = lambda test: F.get(F.filter(flat, test), 0)
    gone = lambda a: (a["type"] == "native_templates") & (F.lower(blank(a["title"])).rlike("isn't available|not available right now") | F.lower(blank(a["description"])).contains("isn't available"))
    embed = F.coalesce(first(lambda a: blank(a["target"]["id"]) != ""), first(lambda a: (a["type"] == "share") & (blank(a["url"]) != "")), first(gone))
    rows = rows.withColumn("text", text).withColumn("media", media).withColumn("embed", embed).where((F.col("text") != "") | (F.size("media") > 0) | F.col("p.place").isNotNull())
    e, targeted = F.col("embed"), blank(F.col("embed.target.id")) != ""
    inline = F.coalesce(F.nullif(e["description"], F.lit("")), F.nullif(e["title"], F.lit("")), F.lit(""))
    outside = F.array_join(F.filter(F.array(blank(e["title"]), blank(e["description"])), lambda x: F.trim(x) != ""), "\n\n")
    body = F.when(e["type"] == "native_templates", "").when(targeted, inline).otherwise(outside)
    url = F.when(e["type"] == "native_templates", blank(F.col("p.permalink_url"))).otherwise(blank(e["url"]))
    repeats = (T.collapse(body) != "") & (T.collapse(body) == T.collapse(F.col("text")))
    reshared = F.when(e.isNotNull() & ~repeats, F.struct(F.lit("").alias("author"), url.alias("url"), body.alias("content_text")))
    code = lambda names, c, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), F.lit(other))
    reactions = F.transform(F.coalesce("p.reactions.data", F.array()), lambda r: F.struct(code(REACTIONS, F.upper(r["type"]), REACTIONS["OTHER"]).alias("type"), blank(r["name"]).alias("user"), F.lit("").alias("user_url"))).cast(REACTION)
    said = F.transform(F.coalesce("p.comments.data", F.array()), lambda c: F.struct(blank(c["from"]["name"]).alias("author"), F.lit("").alias("author_url"), blank(c["message"]).alias("text"), dates.iso(c["created_time"]).alias("date"), blank(c["id"]).alias("source_id"), blank(c["parent"]["id"]).alias("parent_comment_id"))).cast(COMMENTS)
    pairs = F.array(*[F.struct(F.lit(f"fb_{k}_total_count").alias("k"), F.coalesce(F.col(f"p.{k}s.summary.total_count"), F.lit(0)).alias("v")) for k in ("comment", "reaction")])
    place = F.when(F.col("p.place").isNotNull(), F.struct(blank(F.col("p.place.name")).alias("name"), F.coalesce("p.place.location.latitude", F.lit(0.0)).alias("lat"), F.coalesce("p.place.location.longitude", F.lit(0.0)).alias("lng")))
    return record(
        rows, source=F.lit(FACEBOOK), source_id=F.col("p.id"), source_url=blank(F.col("p.permalink_url")), created_at=dates.iso(F.col("p.created_time")), updated_at=dates.iso(F.col("p.updated_time")), content_text=F.col("text"),
        visibility=code(PRIVACY, F.col("p.privacy.value"), FRIENDS), location=place, reshared_from=reshared, media=F.col("media"), reactions=reactions, comments=said, tags=T.hashtags(F.col("text")),
        extra=F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["v"] > 0), lambda p: F.struct(p["k"], p["v"].cast("string")))))


def told_empty(rows: DataFrame) -> DataFrame:
    """(post) of the posts (p) whose count of comments is 0, so that the edge isn't asked for them."""
    return rows.where("p.comments.summary.total_count = 0").select(F.col("p.id").alias("post")).distinct()


def with_edge_comments(records: DataFrame, edge: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Comments from the edge (post, seq, comment) for records that came without any; not for the posts of `empty`, if given."""
    edge = edge.join(empty, "post", "left_anti") if empty is not None else edge
    found = edge.groupBy("post").agg(F.sort_array(F.collect_list(F.struct("seq", "comment"))).alias("l")).select(F.col("post").alias("source_id"), F.transform("l", lambda x: x["comment"]).alias("more"))
    joined = records.join(found, "source_id", "left")
    wanted = (F.size("comments") == 0) & F.col("more").isNotNull()
    return joined.withColumn("comments", F.when(wanted, F.col("more")).otherwise(F.col("comments"))).drop("more").select(*records.columns)


# Where a video's number is in a URL; the first form that is there decides.
VIDEO_FORMS = (r"(?i)facebook\.com/reel/([0-9]+)", r"(?i)facebook\.com/[^/]+/videos/([0-9]+)", r"[?&]v=([0-9]+)")


def video_id(url) -> F.Column:
    """The number of a video, empty if the URL is that of none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, form, 1), F.lit("")) for form in VIDEO_FORMS], F.lit(""))
