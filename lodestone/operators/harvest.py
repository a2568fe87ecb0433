"""What a harvest counts, and the order in which it works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lodestone.sources.schema import LINK


def to_enrich(media: DataFrame, overwrite: bool = False) -> DataFrame:
    """Links with a URL (media_type, original_url, embed_title, og_image) that have neither title nor image yet, or all of them."""
    links = media.where((F.col("media_type") == LINK) & (F.col("original_url") != ""))
    return links if overwrite else links.where((F.col("embed_title") == "") & (F.col("og_image") == ""))


def totals(items: DataFrame, text: str) -> DataFrame:
    """(items, with_text): how many there are, and how many have a text."""
    return items.agg(F.count("*").alias("items"), F.count_if(F.length(F.coalesce(text, F.lit(""))) > 0).alias("with_text"))


def provenance(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, origin, n): how often each field came from each origin; empty origins aren't counted."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("origin")) for f in fields])).alias("p")).select("p.*")
    return pairs.where("origin <> ''").groupBy("field", "origin").agg(F.count("*").alias("n"))


def backfill(chunks: DataFrame, post: str, old_hash: str, new_hash: str) -> DataFrame:
    """One row: chunks to embed, posts they touch, and chunks skipped as they haven't changed or are empty (a null new hash)."""
    empty = F.col(new_hash).isNull()
    same = F.coalesce(F.col(new_hash) == F.col(old_hash), F.lit(False))
    done = ~empty & ~same
    return chunks.agg(
        F.count_if(done).alias("embedded"), F.count_distinct(F.when(done, F.col(post))).alias("posts_touched"),
        F.count_if(same).alias("skipped_hash"), F.count_if(empty).alias("skipped_empty"))


def hinted_first(rows: DataFrame, hinted: Column, seq: str) -> DataFrame:
    """Rows that may have media first, otherwise in their order."""
    return rows.orderBy(F.when(hinted, 0).otherwise(1), seq)


#: The order in which a reader expects words: that of Unicode's root locale, accents and case after letters.
LOCALE = "UNICODE"


def collated(rows: DataFrame, key: str) -> DataFrame:
    """Rows in a locale's order of a text, equal ones by bytes; a sort over all tasks."""
    return rows.orderBy(F.collate(key, LOCALE), key)


def in_order(key: str, groups: list) -> WindowSpec:
    """The same order within groups."""
    return Window.partitionBy(*groups).orderBy(F.collate(key, LOCALE), key)


def by_time(rows: DataFrame, at: str, key: str) -> DataFrame:
    """The order of an export: by time, undated rows first."""
    return rows.orderBy(F.asc_nulls_first(at), key)
