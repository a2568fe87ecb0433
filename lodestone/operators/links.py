"""Joins of an archive's parts by URL, path, name and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import apart

#: A reshare without its original.
MISSING = "(original post not available)"


def by_first_key(rows: DataFrame, row_id: str, candidates: list[Column], found: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """`rows` with `value` of the first of its candidate keys that `found` has, else null."""
    keys = rows.select(row_id, F.posexplode(F.array(*candidates)).alias("_pos", key)).where(f"{key} is not null and {key} <> ''")
    hits = keys.join(found.select(key, value), key).groupBy(row_id).agg(F.min_by(value, "_pos").alias(out))
    return rows.join(hits, row_id, "left")


def seen_once(entries: DataFrame, owner: str, path: str) -> DataFrame:
    """Entries whose path no other owner has. Owners are compared by least and largest, so a path of all owners costs no more."""
    shared = entries.groupBy(path).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi")).where("_lo < _hi").select(apart(path))
    return entries.join(shared, path, "left_anti")


def guarded_whitelist(entries: DataFrame, allowed: DataFrame, owner: str, path: str, always: Column) -> DataFrame:
    """Entries on their owner's list, or `always` kept; all of an owner's where that would leave none."""
    marked = entries.withColumn("_always", always).join(allowed.select(owner, path).distinct().withColumn("_listed", F.lit(True)), [owner, path], "left")
    marked = marked.withColumn("_fits", F.col("_always") | F.coalesce("_listed", F.lit(False)))
    some = marked.where("_fits").select(owner).distinct().withColumn("_some", F.lit(True))
    return marked.join(some, owner, "left").where(F.col("_fits") | F.col("_some").isNull()).select(*entries.columns)


def reshare_states(rows: DataFrame) -> DataFrame:
    """`rows` (id, seq, reshare, own, segment, commentary, target, text) with state 1-8 and other_id.

    1 no reshare; 2 own without words and target: a post; 3 own, a text seen before: deleted; 4 own, paired with another's row of
    that text (the last one), which is deleted; 5 own with a target; 6 own with words only; 7 another's, unpaired; 8 without a
    profile; 9 another's that state 4 deletes. Everything is aggregates by text and one join, no loop over rows.
    """
    flagged = rows.withColumn("_own_flag", F.col("reshare") & F.col("own") & ((F.col("commentary") != "") | (F.col("target") != "")))
    flagged = flagged.withColumn("_other_flag", F.col("reshare") & ~F.col("own")).withColumn("_text", F.sha2("text", 256))
    by_text = flagged.where("_own_flag or _other_flag").groupBy("_text").agg(
        F.min(F.when(F.col("_own_flag"), F.col("seq"))).alias("_first_own"), F.max(F.when(F.col("_other_flag"), F.struct("seq", "id"))).alias("_last_other"))
    by_text = by_text.select(apart("_text"), "_first_own", "_last_other")
    joined = flagged.join(by_text, "_text", "left")
    other = F.col("_last_other.id")
    paired = F.col("_first_own").isNotNull() & other.isNotNull()
    state = (
        F.when(~F.col("reshare"), 1)
        .when(F.col("own") & ~F.col("_own_flag"), 2)
        .when(F.col("own") & (F.col("seq") > F.col("_first_own")), 3)
        .when(F.col("own") & paired, 4)
        .when(F.col("own") & (F.col("target") != ""), 5)
        .when(F.col("own"), 6)
        .when(paired & (F.col("id") == other), 9)
        .when(F.col("segment") == "", 8)
        .otherwise(7)
    )
    return joined.withColumn("state", state).withColumn("other_id", F.when(F.col("state") == 4, other)).drop("_own_flag", "_other_flag", "_text", "_first_own", "_last_other")


def originals(reshares: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, original_id): a reshare's post by its URL, else by an id in its path; never itself."""
    from lodestone.functions.urls import path

    by_url = posts.select(F.col("source_url").alias("reshared_url"), F.col("id").alias("by_url")).where("reshared_url <> ''").groupBy("reshared_url").agg(F.min("by_url").alias("by_url"))
    by_id = posts.select(F.col("source_id").alias("token"), F.col("id").alias("by_id")).where("token <> ''").groupBy("token").agg(F.min("by_id").alias("by_id"))
    token = F.get(F.filter(F.split(path(F.col("reshared_url")), "/"), lambda x: x.startswith("pfbid") | x.rlike(r"^\d+$")), 0)
    rows = reshares.select("id", "reshared_url", token.alias("token")).join(by_url, "reshared_url", "left").join(by_id, "token", "left")
    return rows.select("id", F.nullif(F.coalesce("by_url", "by_id"), F.col("id")).alias("original_id")).where("original_id is not null")


def named_by_prefix(rows: DataFrame, url: str, names: DataFrame, prefix: str, name: str, row_id: str) -> DataFrame:
    """(row_id, name) of the profile whose URL `url` starts with; the longest one, then the least name.

    An equi-join: a URL's prefixes that end before /, ? or # or at its end are its candidate keys. Of a prefix's names the least is joined
    alone, so a prefix of many names and many URLs makes a row for each URL, not for each pair.
    """
    names = names.groupBy(prefix).agg(F.min(F.struct(name)).getField(name).alias(name)).select(apart(prefix), name)
    ends = F.concat(F.filter(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(F.concat(F.col(url), F.lit("/")), i + 1, F.lit(1)).isin("/", "?", "#")), F.array(F.length(url)))
    keys = rows.select(row_id, F.explode(F.array_distinct(F.transform(ends, lambda i: F.substring(F.col(url), F.lit(1), i)))).alias(prefix))
    return keys.join(names, prefix).groupBy(row_id).agg(F.min_by(name, F.struct(-F.length(prefix), F.col(name))).alias(name))
