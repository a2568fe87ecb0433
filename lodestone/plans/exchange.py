"""Records written and read, and the list of everything else that moves in or out."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.views import POSTS, posts
from lodestone.session import cut, shared_dir, table
from lodestone.sources import binpb, binpb_source, paging, schema, sinks, web_archive


def as_records(spark, sf_dir):
    rows = posts(spark, sf_dir)
    comments = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("said"))
    rows = rows.join(comments, "id", "left")
    comment = F.struct(F.lit("reader").alias("author"), F.lit("").alias("author_url"), F.col("said").alias("text"), F.lit(None).cast("timestamp").alias("date"), F.lit("").alias("source_id"), F.lit("").alias("parent_comment_id"))
    return schema.record(
        rows, source=F.col("source"), source_id=F.col("id").cast("string"), created_at=F.col("created_at").cast("timestamp"), content_text=F.col("content_text"), visibility=F.col("visibility"), tags=F.array("lang", "source_name"),
        comments=F.when(F.col("said").isNotNull(), F.array(comment)).otherwise(F.array()).cast(schema.COMMENTS), reshared_from=F.when(F.col("reshared_from_author") != "", F.struct(F.col("reshared_from_author").alias("author"), F.lit("").alias("url"), F.lit("").alias("content_text"))),
        extra=F.create_map(F.lit("tw_like_count"), (F.col("id") % 9).cast("string"), F.lit("tw_reply_count"), F.lit("x")))


def round_trip(spark, sf_dir):
    """All posts as records in the wire format, read again."""
    path = f"{shared_dir(spark)}/records-{uuid4().hex}"
    binpb.write(as_records(spark, sf_dir), path)
    return compared(binpb.read_written(spark, path))


def compared(back):
    return back.select("source", "source_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "visibility", F.sha2("content_text", 256).alias("text_sha"), F.array_join("tags", ",").alias("tags"), F.coalesce("reshared_from.author", F.lit("")).alias("author"), F.size("comments").cast("long").alias("comments"))


def source_round_trip(spark, sf_dir):
    """The same by the data source: many tasks for each file, and files that are there once all tasks are done."""
    spark.dataSource.register(binpb_source.BinpbSource)
    path = f"{shared_dir(spark)}/records-{uuid4().hex}"
    as_records(spark, sf_dir).write.format("binpb").mode("append").save(path)
    return compared(spark.read.format("binpb").option("rangeBytes", 1 << 20).load(path))


def import_rows(spark, sf_dir):
    rows = schema.serving_rows(as_records(spark, sf_dir), 4)
    return rows.select("source", "source_id", "visibility", "reshared_from_author", F.col("reaction_count").cast("long").alias("reactions"), F.col("comment_count").cast("long").alias("comments"))


def import_counters(spark, sf_dir):
    rows = as_records(spark, sf_dir)
    return rows.agg(F.count("*").alias("records"), F.count_if(F.col("content_text") == "").alias("empty"), F.count_if(F.col("created_at").isNull()).alias("undated"), F.count_if(F.size("comments") > 0).alias("discussed"))


#: Posts and comments of a page.
POSTS_PAGE, COMMENTS_PAGE = 4, 2
NO_EDGE = '{"error": {"message": "not here", "code": 200, "error_subcode": 2069030}}'


def customers_pages(spark, sf_dir):
    """(url, body): the orders of each customer as an API would page them. Every fifth customer has a feed only; of every tenth its third page fails."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("message"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("id").cast("long"))) - 1
    pages = orders.withColumn("n", number).groupBy("o_custkey", F.floor(F.col("n") / POSTS_PAGE).alias("k")).agg(F.sort_array(F.collect_list(F.struct("n", F.struct("id", "message").alias("post")))).alias("l"))
    own, feed, k = F.col("o_custkey").cast("string"), F.col("o_custkey") % 5 == 0, F.col("k")
    url = lambda k: F.when(feed & (k == 0), F.concat(own, F.lit("?fields=feed"))).otherwise(F.concat(own, F.when(feed, "/feed").otherwise("/posts"), F.when(k > 0, F.concat(F.lit("?after="), k.cast("string"))).otherwise("")))
    more = k < F.max("k").over(Window.partitionBy("o_custkey"))
    page = F.struct(F.transform("l", lambda x: x["post"]).alias("data"), F.struct(F.when(more, F.concat(url(k + 1), F.lit("&access_token=secret"))).alias("next")).alias("paging"))
    body = F.when((F.col("o_custkey") % 10 == 0) & (k == 2), NO_EDGE).when(feed & (k == 0), F.to_json(F.struct(page.alias("feed")))).otherwise(F.to_json(page))
    pages = pages.select(url(k).alias("url"), body.alias("body"))
    return pages.union(orders.where(feed).select(F.concat(own, F.lit("/posts")).alias("url"), F.lit(NO_EDGE).alias("body")).distinct())


def graph_chains(spark, sf_dir):
    """The posts of every profile by its chain of pages, by whichever edge it has."""
    starts = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    starts = starts.select("key", F.concat("key", F.lit("/posts?access_token=x")).alias("posts_url"), F.concat("key", F.lit("?fields=feed")).alias("feed_url"))
    found = paging.posts(paging.pages(customers_pages(spark, sf_dir)), starts)
    return found.select(F.col("key").cast("long").alias("customer"), "place", F.col("pos").cast("long").alias("pos"), F.get_json_object("item", "$.id").cast("long").alias("post"), F.get_json_object("item", "$.message").alias("message"))


def graph_comments(spark, sf_dir):
    """The comments of conversations' first turns: all pages after the post's own, else those of its edge, unless the post says 0 or the edge breaks off."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    rows = turns.withColumn("n", number).groupBy("conv_id", F.floor(F.col("n") / COMMENTS_PAGE).alias("k")).agg(F.sort_array(F.collect_list(F.struct("n", F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("n").cast("string")).alias("id"), F.col("text").alias("message")).alias("said")))).alias("l"))
    rows = rows.withColumn("last", F.max("k").over(Window.partitionBy("conv_id")))
    kind, own, k = F.col("conv_id") % 4, F.col("conv_id").cast("string"), F.col("k")
    url = lambda k: F.concat(own, F.lit("/comments"), F.when(k > 0, F.concat(F.lit("?after="), k.cast("string"))).otherwise(""))
    page = F.struct(F.transform("l", lambda x: x["said"]).alias("data"), F.struct(F.when(k < F.col("last"), url(k + 1)).alias("next")).alias("paging"))
    saved = rows.select(url(k).alias("url"), F.when((kind == 3) & (k == 1), F.lit('{"error": {"message": "gone"}}')).otherwise(F.to_json(page)).alias("body"))
    none = F.from_json(F.lit('{"data": []}'), "data array<struct<id:string,message:string>>, paging struct<next:string>, summary struct<total_count:bigint>")
    full = F.struct(page["data"].alias("data"), page["paging"].alias("paging"), F.lit(None).cast("struct<total_count:bigint>").alias("summary"))
    block = F.when(kind == 0, full).when(kind == 2, none.withField("summary", F.struct(F.lit(0).cast("long").alias("total_count")))).otherwise(none)
    found = rows.where("k = 0").select(own.alias("key"), F.to_json(F.struct(own.alias("id"), block.alias("comments"))).alias("item"))
    said = paging.comments(paging.pages(saved), found)
    said = said.select(F.col("post").cast("long").alias("conv_id"), F.posexplode("comments").alias("n", "said"))
    return said.select("conv_id", F.col("n").cast("long").alias("n"), F.sha2(F.get_json_object("said", "$.message"), 256).alias("text_sha"))


def address_digests(spark, sf_dir):
    """Callers by address: a proxy's header, else the first of a chain, else the connection's own; only salted digests are given out."""
    k = F.col("c_custkey")
    real = F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), (k % 250).cast("string"))).when(k % 3 == 1, "")
    forwarded = F.when(k % 2 == 0, F.concat(F.lit("10.1."), (k % 90).cast("string"), F.lit(".1 , 10.9.9.9")))
    remote = F.when(k % 7 != 0, F.concat(F.lit("10.2.0."), (k % 200).cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", T.address_digest(T.caller_address(real, forwarded, remote), "salt").alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("calls"), F.min("c_custkey").alias("first"))


def profile_link_file(spark, sf_dir):
    """Names and URLs of suppliers and customers written as one JSON object, and read again."""
    path = f"{shared_dir(spark)}/profiles-{uuid4().hex}"
    people = [table(spark, sf_dir, t).select(F.col(f"{c}_name").alias("name"), F.concat(F.lit('https://f.example/"'), F.col(f"{c}_{k}").cast("string")).alias("url")) for t, c, k in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))]
    sinks.write_profile_links(people[0].union(people[1]).union(people[0].withColumn("url", F.concat("url", F.lit("x")))), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "url"))


def media_copies(spark, sf_dir):
    """Pages as media files, put into folders by month; a name that is there already is left as it is."""
    folder = f"{binpb_source.folder_of(shared_dir(spark))}/media-{uuid4().hex}"
    pages = table(spark, sf_dir, "pages").where("page_id is not null")
    created = F.when(F.col("page_id") % 5 != 0, F.timestamp_seconds(F.lit(1_500_000_000) + F.col("page_id") * 86_400))
    files = pages.select(F.concat(F.lit("from/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), created.alias("created_at"))
    first = cut(sinks.copy_media(files.where("pmod(hash(name), 2) = 0"), folder))
    again = cut(sinks.copy_media(files, folder))
    both = again.join(first.select("name", F.col("copied").alias("before")), "name", "left")
    return both.select("name", "local_path", (F.coalesce("before", F.lit(False)) != F.col("copied")).alias("once"))


def found_snapshots(handle):
    """A search that knows some snapshots of every handle but those that end in 7, and pages that are no messages."""
    n = int(handle.rsplit("_", 1)[1])
    if n % 10 == 7:
        return []
    return [(f"2019{1 + k:02d}01000000", f"https://twitter.com/{handle}/status/{n * 10 + k}") for k in range(n % 4)] + [("20190101000000", f"https://twitter.com/{handle}")]


def snapshot_cache(spark, sf_dir):
    """The snapshots of all suppliers' handles, half of which a search before has put into the cache."""
    cache = f"{shared_dir(spark)}/snapshots-{uuid4().hex}"
    handles = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" @Supplier_"), F.col("s_suppkey").cast("string")).alias("handle"))
    web_archive.snapshot_lists(handles.where("pmod(hash(handle), 2) = 0"), cache, found_snapshots)
    return web_archive.snapshot_lists(handles, cache, found_snapshots)


QUERIES = {
    "address_digests": address_digests, "profile_link_file": profile_link_file, "media_copies": media_copies, "snapshot_cache": snapshot_cache,
    "graph_chains": graph_chains, "graph_comments": graph_comments, "binpb_round_trip": round_trip, "binpb_source_round_trip": source_round_trip, "import_rows": import_rows, "import_counters": import_counters}
_ROUND_TRIP = f"""with {POSTS} select source, id::varchar as source_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created, visibility, sha256(content_text) as text_sha, lang || ',' || source_name as tags, reshared_from_author as author,
        (id in (select conv_id from conversations))::bigint as comments from posts"""
ORACLE_SQL = {
    "address_digests": """with a as (select c_custkey as k, case when c_custkey % 3 = 0 then '10.0.0.' || c_custkey % 250 when c_custkey % 2 = 0 then '10.1.' || c_custkey % 90 || '.1' when c_custkey % 7 <> 0 then '10.2.0.' || c_custkey % 200 end as address from customer)
        select case when address is null then '' else sha256('salt|' || address) end as digest, count(*) as calls, min(k) as first from a group by 1""",
    "profile_link_file": """select c_name as name, 'https://f.example/"' || c_custkey as url from customer union all select s_name, 'https://f.example/"' || s_suppkey from supplier""",
    "media_copies": """select page_id || '.html' as name, 'media/' || case when page_id % 5 <> 0 then strftime(to_timestamp(1500000000 + page_id * 86400) at time zone 'UTC', '%Y/%m') else 'unknown' end || '/' || page_id || '.html' as local_path, true as once from pages where page_id is not null""",
    "snapshot_cache": """with s as (select s_suppkey as n, unnest(range(0, s_suppkey % 4)) as k from supplier where s_suppkey % 10 <> 7)
        select 'supplier_' || n as handle, '20190' || (1 + k) || '01000000' as timestamp, 'https://twitter.com/supplier_' || n || '/status/' || (n * 10 + k) as url from s""",
    "binpb_source_round_trip": _ROUND_TRIP,
    "graph_chains": f"""with n as (select o_custkey as customer, o_orderkey as post, o_orderpriority as message, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders)
        select customer, n // {POSTS_PAGE} as place, n % {POSTS_PAGE} as pos, post, message from n where customer % 10 <> 0 or n < 2 * {POSTS_PAGE}""",
    "graph_comments": f"""with n as (select conv_id, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as n, count(*) over (partition by conv_id) as all_ from conversations where conv_id is not null and turn is not null)
        select conv_id, n, sha256(text) as text_sha from n where conv_id % 4 in (0, 1) or conv_id % 4 = 3 and all_ <= {COMMENTS_PAGE}""",
    "binpb_round_trip": _ROUND_TRIP,
    "import_rows": f"""with {POSTS} select 4 as source, id::varchar as source_id, visibility, reshared_from_author, id % 9 as reactions, (id in (select conv_id from conversations))::bigint as comments from posts""",
    "import_counters": f"with {POSTS} select count(*) as records, count(*) filter (content_text = '') as empty, count(*) filter (created_at is null) as undated, count(*) filter (id in (select conv_id from conversations)) as discussed from posts",
}
