"""Feeds, pages, indexes by date and archive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.pages import page
from lodestone.plans.views import POSTS, STAMP, posts, public_posts, stamp
from lodestone.session import table

PER_PAGE, RSS, YEAR, SOURCE = 20, 20, 1997, 3


def newest() -> list:
    """Newest first, undated last; ids break ties."""
    return [F.desc_nulls_last("created_at"), F.desc("id")]


def feed_page(number: int):
    def query(spark, sf_dir) -> DataFrame:
        rows = page(public_posts(spark, sf_dir), newest(), number, PER_PAGE)
        return rows.select("id", "source", stamp(F.col("created_at")).alias("created"), F.substring("content_text", 1, 80).alias("title"))

    return query


def source_filter(spark, sf_dir):
    return public_posts(spark, sf_dir).where(F.col("source") == SOURCE).select("id", "lang", "source_name")


def year_filter(spark, sf_dir):
    # a range, so that statistics of files by date can prune
    return public_posts(spark, sf_dir).where(f"created_at >= timestamp_ntz'{YEAR}-01-01' and created_at < timestamp_ntz'{YEAR + 1}-01-01'").select("id", stamp(F.col("created_at")).alias("created"))


def visibility_counts(spark, sf_dir):
    return posts(spark, sf_dir).groupBy("visibility").agg(F.count("*").alias("n"))


def rss_latest(spark, sf_dir):
    rows = public_posts(spark, sf_dir).orderBy(*newest()).limit(RSS)
    return rows.select("id", F.substring("content_text", 1, 80).alias("title"), F.substring("content_text", 1, 300).alias("description"), stamp(F.col("created_at")).alias("published"))


def sitemap_index(spark, sf_dir):
    years = public_posts(spark, sf_dir).where("created_at is not null").groupBy(F.year("created_at").cast("long").alias("year"))
    return years.agg(F.count("*").alias("n"), stamp(F.max("created_at")).alias("last_modified"))


def sitemap_shard(spark, sf_dir):
    rows = year_filter(spark, sf_dir)
    return rows.select(F.concat(F.lit("/post/"), F.col("id").cast("string"), F.lit("/")).alias("location"), F.col("created").alias("last_modified"))


def archive_months(spark, sf_dir):
    months = public_posts(spark, sf_dir).where("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
    return months.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def archive_stats(spark, sf_dir):
    """Counts by source and language with subtotals and the total."""
    rows = posts(spark, sf_dir).rollup("source_name", "lang").agg(F.count("*").alias("n"), F.sum(F.length("content_text")).cast("long").alias("chars"), F.grouping_id().cast("long").alias("level"))
    return rows


def on_this_day(spark, sf_dir, month: int = 6, day: int = 15):
    rows = public_posts(spark, sf_dir).where((F.month("created_at") == month) & (F.dayofmonth("created_at") == day))
    return rows.select("id", F.year("created_at").cast("long").alias("year"), F.substring("content_text", 1, 200).alias("snippet"))


def timeline_range(spark, sf_dir):
    rows = public_posts(spark, sf_dir).where("created_at >= timestamp_ntz'1998-03-01' and created_at < timestamp_ntz'1998-06-01'")
    return rows.select("id", stamp(F.col("created_at")).alias("created"), "source")


def date_drill(spark, sf_dir):
    """The list's drill-down: by year, month and visibility."""
    rows = posts(spark, sf_dir).where("created_at is not null").groupBy(F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM-dd").alias("month"), "visibility")
    return rows.agg(F.count("*").alias("n"))


def hide_source(spark, sf_dir):
    """The bulk change of visibility: all of one source become private."""
    changed = posts(spark, sf_dir).withColumn("visibility", F.when(F.col("source") == SOURCE, 3).otherwise(F.col("visibility")))
    return changed.groupBy("source", "visibility").agg(F.count("*").alias("n"))


def staff_detail(spark, sf_dir, post_id: int = 7, staff: bool = True):
    rows = posts(spark, sf_dir).where(F.col("id") == post_id)
    return (rows if staff else rows.where("visibility = 1")).select("id", "visibility", "lang")


def enum_remap(spark, sf_dir):
    """Numbers of the interchange records as those of the serving tables."""
    source = F.create_map(*[F.lit(x) for x in (1, 2, 2, 3, 3, 4, 4, 1)])
    seen = F.create_map(*[F.lit(x) for x in (0, 1, 1, 1, 2, 2, 3, 3)])
    rows = posts(spark, sf_dir).select("source", source[F.col("source")].alias("stored_source"), (F.col("id") % 4).cast("int").alias("record_visibility"))
    rows = rows.withColumn("stored_visibility", seen[F.col("record_visibility")])
    return rows.groupBy("source", "stored_source", "record_visibility", "stored_visibility").agg(F.count("*").alias("n"))


def post_with_children(spark, sf_dir):
    """Each post with what its children sum to; children are summed before they are joined, never joined with each other."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.count("*").alias("comments"), F.sum(F.length("text")).cast("long").alias("comment_chars"), F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"))
    vectors = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 100).alias("id")).agg(F.count("*").alias("chunks"))
    rows = posts(spark, sf_dir).select("id", "lang").join(turns, "id", "left").join(vectors, "id", "left")
    return rows.select("id", "lang", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce("comment_chars", F.lit(0)).alias("comment_chars"), "first_role", "last_turn", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def tag_page(spark, sf_dir, tag: str = "fr"):
    """Posts of a tag by a semi-join with the tags of posts."""
    all_posts = public_posts(spark, sf_dir)
    tags = all_posts.select("id", F.explode(F.array("lang", "source_name")).alias("slug"))
    return all_posts.select("id", "lang", "source_name").join(tags.where(F.col("slug") == tag), "id", "left_semi")


QUERIES = {
    "public_feed_page": feed_page(1), "feed_page_2": feed_page(2), "source_filter": source_filter, "year_filter": year_filter, "visibility_counts": visibility_counts,
    "rss_latest20": rss_latest, "sitemap_year_index": sitemap_index, "sitemap_shard": sitemap_shard, "archive_year_month": archive_months, "archive_stats_rollup": archive_stats,
    "on_this_day": on_this_day, "timeline_range": timeline_range, "date_drill": date_drill, "bulk_visibility": hide_source, "staff_detail": staff_detail, "enum_remap": enum_remap,
    "post_with_children": post_with_children, "tag_page_semijoin": tag_page,
}

_PAGE = f"with {POSTS} select id, source, {STAMP.format('created_at')} as created, substr(content_text, 1, 80) as title from public_posts order by created_at desc nulls last, id desc limit {PER_PAGE} offset {{}}"
_YEAR = f"from public_posts where created_at >= timestamp '{YEAR}-01-01' and created_at < timestamp '{YEAR + 1}-01-01'"
ORACLE_SQL = {
    "public_feed_page": _PAGE.format(0),
    "feed_page_2": _PAGE.format(PER_PAGE),
    "source_filter": f"with {POSTS} select id, lang, source_name from public_posts where source = {SOURCE}",
    "year_filter": f"with {POSTS} select id, {STAMP.format('created_at')} as created {_YEAR}",
    "visibility_counts": f"with {POSTS} select visibility, count(*) as n from posts group by 1",
    "rss_latest20": f"with {POSTS} select id, substr(content_text, 1, 80) as title, substr(content_text, 1, 300) as description, {STAMP.format('created_at')} as published from public_posts order by created_at desc nulls last, id desc limit {RSS}",
    "sitemap_year_index": f"with {POSTS} select year(created_at)::bigint as year, count(*) as n, {STAMP.format('max(created_at)')} as last_modified from public_posts where created_at is not null group by 1",
    "sitemap_shard": f"with {POSTS} select '/post/' || id || '/' as location, {STAMP.format('created_at')} as last_modified {_YEAR}",
    "archive_year_month": f"with {POSTS} select strftime(created_at, '%Y-%m') as month, count(*) as n, count(distinct source) as sources from public_posts where created_at is not null group by 1",
    "archive_stats_rollup": f"with {POSTS} select source_name, lang, count(*) as n, sum(length(content_text))::bigint as chars, grouping(source_name, lang)::bigint as level from posts group by rollup (source_name, lang)",
    "on_this_day": f"with {POSTS} select id, year(created_at)::bigint as year, substr(content_text, 1, 200) as snippet from public_posts where month(created_at) = 6 and day(created_at) = 15",
    "timeline_range": f"with {POSTS} select id, {STAMP.format('created_at')} as created, source from public_posts where created_at >= timestamp '1998-03-01' and created_at < timestamp '1998-06-01'",
    "date_drill": f"with {POSTS} select strftime(date_trunc('month', created_at), '%Y-%m-%d') as month, visibility, count(*) as n from posts where created_at is not null group by 1, 2",
    "bulk_visibility": f"with {POSTS} select source, case when source = {SOURCE} then 3 else visibility end as visibility, count(*) as n from posts group by 1, 2",
    "staff_detail": f"with {POSTS} select id, visibility, lang from posts where id = 7",
    "enum_remap": f"""with {POSTS}, r as (select source, case source when 1 then 2 when 2 then 3 when 3 then 4 else 1 end as stored_source, (id % 4)::int as record_visibility from posts)
        select source, stored_source, record_visibility, case record_visibility when 2 then 2 when 3 then 3 else 1 end as stored_visibility, count(*) as n from r group by all""",
    "post_with_children": f"""with {POSTS}, t as (select conv_id as id, count(*) as comments, sum(length(text))::bigint as comment_chars, arg_min(role, turn) as first_role, max(turn) as last_turn from conversations group by 1),
        v as (select vec_id % 100 as id, count(*) as chunks from embeddings group by 1)
        select id, lang, coalesce(comments, 0) as comments, coalesce(comment_chars, 0) as comment_chars, first_role, last_turn, coalesce(chunks, 0) as chunks from posts left join t using (id) left join v using (id)""",
    "tag_page_semijoin": f"with {POSTS} select id, lang, source_name from public_posts where lang = 'fr' or source_name = 'fr'",
}
