"""The archive's views over the given tables, as DataFrames and as the same text for the SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import table


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content_text, lang, source_name, source, visibility, created_at, reshared_from_author."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    network = F.pmod(F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(0)), F.lit(4)) + 1
    hidden = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    created = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))
    author = F.when(F.col("id") % 5 == 0, F.concat(F.lit("author"), (F.col("id") % 7).cast("string"))).otherwise("")
    joined = docs.join(labels, "id", "left").join(orders, "id", "left")
    return joined.select("id", F.col("text").alias("content_text"), "lang", F.col("source").alias("source_name"), network.alias("source"), hidden.alias("visibility"), created.alias("created_at"), author.alias("reshared_from_author"))


def public_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one view that every public reading path hangs off."""
    return posts(spark, sf_dir).where("visibility = 1")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 100).alias("post_id"), F.floor(F.col("vec_id") / 100).alias("chunk_index"), "embedding")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ip, micros, premium, k: events as calls of a rate-limited service."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.col("user_id").alias("ip"), micros(F.col("ts")).alias("micros"), (F.col("event_type") == "purchase").alias("premium"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def post_slug(day: Column) -> Column:
    """Date and the first eight words of the text's first 60 characters."""
    head = F.array_join(F.slice(F.split(T.strip(F.substring("content_text", 1, 60)), r"\s+"), 1, 8), "-")
    return T.slug(F.concat(day, F.lit("-"), head))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


POSTS = """posts as (
  select d.doc_id as id, d.text as content_text, d.lang, d.source as source_name, 1 + coalesce(try_cast(substr(d.source, 4, 9) as int), 0) % 4 as source,
         case when l.toxic = 1 then 3 when l.quality = 0 then 2 else 1 end as visibility, o.o_orderdate + to_seconds(d.doc_id) as created_at,
         case when d.doc_id % 5 = 0 then 'author' || (d.doc_id % 7) else '' end as reshared_from_author
  from documents d left join labels l on l.doc_id = d.doc_id left join orders o on o.o_orderkey = d.doc_id),
public_posts as (select * from posts where visibility = 1)"""
CHUNKS = "chunks as (select vec_id as chunk_id, vec_id % 100 as post_id, vec_id // 100 as chunk_index, embedding from embeddings)"
ATTEMPTS = "attempts as (select event_id, user_id as ip, epoch_us(ts) as micros, event_type = 'purchase' as premium, (props->>'$.k')::bigint as k from events)"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
