"""The interchange record of a post, its numbers and how they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of the interchange records.
GOOGLE_PLUS, FACEBOOK, TWITTER, BLOG = 1, 2, 3, 4
PUBLIC, FRIENDS, PRIVATE = 1, 2, 3
IMAGE, VIDEO, GIF, LINK = 1, 2, 3, 4
REACTIONS = {"PLUS_ONE": 1, "LIKE": 2, "RETWEET": 3, "OTHER": 4, "LOVE": 5, "HAHA": 6, "WOW": 7, "SAD": 8, "ANGRY": 9, "CARE": 10}
# The serving tables' numbers for these; whatever is missing takes the last number given to stored().
STORED_VISIBILITY = {PUBLIC: 1, FRIENDS: 2, PRIVATE: 3}
STORED_REACTION = {1: 1, 2: 2, 3: 3}
STORED_SOURCE = {GOOGLE_PLUS: 2, FACEBOOK: 3, TWITTER: 4, BLOG: 1}

MEDIA = "array<struct<type:int,original_url:string,original_filename:string,local_path:string,caption:string>>"
COMMENTS = "array<struct<author:string,author_url:string,text:string,date:timestamp,source_id:string,parent_comment_id:string>>"
REACTION = "array<struct<type:int,user:string,user_url:string>>"
LOCATION, RESHARED = "struct<name:string,lat:double,lng:double>", "struct<author:string,url:string,content_text:string>"
FIELDS = {
    "source": "int", "source_id": "string", "source_url": "string", "created_at": "timestamp", "updated_at": "timestamp", "title": "string", "content_text": "string", "content_html": "string",
    "visibility": "int", "location": LOCATION, "reshared_from": RESHARED, "media": MEDIA, "reactions": REACTION, "comments": COMMENTS, "tags": "array<string>", "extra": "map<string,string>",
}
RECORD = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
_EMPTY = {"int": lambda: F.lit(0), "string": lambda: F.lit(""), "map<string,string>": lambda: F.create_map()}


def record(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as records: given columns, and for the rest what means absent: '', 0, no rows, null for times and structs."""

    def empty(kind: str) -> Column:
        if kind.startswith("array"):
            return F.array().cast(kind)
        return _EMPTY.get(kind, lambda: F.lit(None))().cast(kind)

    return df.select(*[columns[k].cast(v).alias(k) if k in columns else empty(v).alias(k) for k, v in FIELDS.items()])


def stored(c: Column, numbers: dict[int, int], other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), c), F.lit(other))


def hint(extra: Column, key: str) -> Column:
    """A count in a record's extra values; 0 if it is no number."""
    return F.coalesce(F.try_element_at(extra, F.lit(key)).try_cast("int"), F.lit(0))


def serving_rows(records: DataFrame, source: int) -> DataFrame:
    """Rows of the post table: numbers mapped, counts raised to the platform's hints."""
    counts = lambda rows, *keys: F.greatest(F.size(rows), *[hint(F.col("extra"), k) for k in keys])
    return records.select(
        F.lit(source).alias("source"), "source_id", "source_url", "created_at", "updated_at", "title", "content_text", "content_html", stored(F.col("visibility"), STORED_VISIBILITY, 1).alias("visibility"),
        F.coalesce("reshared_from.author", F.lit("")).alias("reshared_from_author"), F.coalesce("reshared_from.url", F.lit("")).alias("reshared_from_url"), F.coalesce("reshared_from.content_text", F.lit("")).alias("reshared_content_text"),
        counts("reactions", "fb_reaction_total_count", "tw_like_count").alias("reaction_count"), counts("comments", "fb_comment_total_count", "tw_reply_count").alias("comment_count"), F.size("media").alias("media_count"))
