"""Stories and their media out of captured responses, as variants that are walked level by level, without Python for rows.

A level is a table of objects and arrays; its members come by variant_explode, and only members that are objects or arrays go on, so
there are as many rounds as the deepest text has levels, and each is cut. What an object says is read from it by paths.

Cases: a null or empty text, and one that isn't JSON, has no nodes; JSON values on lines are one text; a line that can't be read is
skipped; of a value that spans lines nothing but itself is read. Members of an object follow each other by their names, as variants keep them so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

# Keys of a story's ids; types of nodes whose `id` is a story's; keys of its time; keys of objects with an image; keys of videos.
IDS = ("post_id", "legacy_story_api_id", "story_id", "fbid", "token")
TYPES = ("Story", "Post")
TIMES = ("creation_time", "created_time", "publish_time", "publishTime")
NUMBERED_BY = ("creation_time", "created_time", "publish_time")
IMAGES = ("image", "large_image", "viewer_image", "preferred_image")
VIDEOS = ("playable_url", "playable_url_quality_hd", "browser_native_hd_url", "browser_native_sd_url", "hd_src", "sd_src")
SITE = "facebook.com"
#: From here on a time is one of milliseconds.
MILLIS = 10**12


def member(node: Column, path: str) -> Column:
    return F.try_variant_get(node, f"$.{path}", "variant")


def text_of(value: Column) -> Column:
    return F.when(~held(value), F.try_variant_get(value, "$", "string"))


def held(value: Column) -> Column:
    """Whether a variant holds others."""
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")


def string(value: Column) -> Column:
    """The text of a variant that is one, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def story_ids(node: Column) -> Column:
    """The ids of a node as a story and its URL on the network, each once; a bare `id` counts beside a URL or a story's type."""
    url = string(member(node, "url"))
    story = F.coalesce(string(member(node, "__typename")).isin(*TYPES), F.lit(False)) | url.isNotNull()
    found = [text_of(member(node, k)) for k in IDS] + [F.when(story, text_of(member(node, "id"))), F.when(url.contains(SITE), url)]
    return F.array_distinct(F.filter(F.transform(F.array(*found), lambda x: F.trim(x)), lambda x: x != ""))


def epoch(raw: Column, quoted: Column) -> Column:
    """Whole seconds of a number or a quoted run of digits, in seconds or milliseconds, or of an ISO text; null if it isn't after 1970."""
    iso = F.unix_timestamp(F.regexp_replace(F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), raw), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))
    number = F.when(~quoted | raw.rlike("^[0-9]+$"), raw.try_cast("double"))
    number = F.when(number < 10**18, F.when(number > MILLIS, number / 1000).otherwise(number))  # nor if it is beyond all calendars
    at = F.coalesce(F.floor(number), F.when(quoted, iso))
    return F.when(at > 0, at)


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """`rows` and further columns, each computed once: as plain columns they would be put into every expression that uses them."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def values(text: Column) -> Column:
    """The JSON values of a text: those of its lines, or the whole where its first line isn't one but the whole is."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.try_parse_json), lambda v: v.isNotNull())
    whole = F.try_parse_json(text)
    alone = F.try_parse_json(F.regexp_extract(text, r"^\s*([^\n]*)", 1)).isNull() & whole.isNotNull()
    return F.when(alone, F.array(whole)).otherwise(lines)


def walk(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, place, node, own, around): every object in the texts, its own ids as a story, and those of the nearest story around or at it.

    `place` orders the objects of a text as they stand in it. Keys may have any names; they come back as one struct `row`.
    """
    here = F.coalesce(F.when(F.size("own") > 0, F.col("own")), F.when(numbered(F.col("node")), F.array(string(member(F.col("node"), "id")))), F.col("around"))
    rows = texts.select(F.struct(*keys).alias("row"), F.posexplode(values(F.col(text))).alias("line", "node"))
    level = rows.select("row", F.array("line").alias("place"), "node", F.lit(None).cast("array<string>").alias("around"))
    found = []
    while True:
        level = level.where(held(F.col("node"))).withColumn("own", story_ids(F.col("node")))
        level = cut(level.withColumn("around", here))
        found.append(level)
        if level.isEmpty():
            break
        below = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer()))
        level = below.select("row", F.array_append("place", F.col("pos")).alias("place"), F.col("value").alias("node"), "around")
    return reduce(DataFrame.union, found).where(F.schema_of_variant("node").startswith("OBJECT<"))


def numbered(node: Column) -> Column:
    """Nodes without a story's id that have a text as `id` and a time, if only null, count as stories."""
    dated = reduce(Column.__or__, (member(node, k).isNotNull() for k in NUMBERED_BY))
    return dated & (string(member(node, "id")) != "")


def times(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, post, at): of each id in a text the time of its first node that has one of its own."""
    some = texts.where(reduce(Column.__or__, (F.col(text).contains(k) for k in TIMES)))  # others have none
    node, value = F.col("node"), F.col("value")
    rows = once(walk(some, text, *keys), F.coalesce(*[F.when(~F.is_variant_null(member(node, k)), member(node, k)) for k in TIMES]).alias("value"))
    rows = once(rows.where("size(own) > 0"), F.trim(text_of(value)).alias("raw"), (F.schema_of_variant(value) == "STRING").alias("quoted"))
    rows = rows.select("row", "place", epoch(F.col("raw"), F.col("quoted")).alias("at"), F.explode("own").alias("post")).where("at is not null")
    return rows.groupBy("row", "post").agg(F.min_by("at", "place").alias("at")).select("row.*", "post", "at")


def media(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, post, url): each image and video once for each id of the story it stands in."""
    node = F.col("node")
    urls = F.array(*[string(member(node, f"{k}.uri")) for k in IMAGES], *[string(member(node, k)) for k in VIDEOS])
    rows = walk(texts, text, *keys).select("row", "around", F.explode(F.filter(urls, lambda u: u.startswith("http"))).alias("url"))
    return rows.select("row", F.explode("around").alias("post"), "url").distinct().select("row.*", "post", "url")
