"""Duplicates, links between an archive's parts, as-of joins and merges."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.text import humanise
from lodestone.operators import asof, filetable, keep, links, merge, threads
from lodestone.operators import slugs as S
from lodestone.operators.pages import capped
from lodestone.plans.views import POSTS, micros, post_slug, posts
from lodestone.session import shared_dir, table

HOUR = 3_600_000_000
REPLY_GAP, COMMENT_GAP = 72 * HOUR, 7 * 24 * HOUR


def dedup_longest(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return keep.longest(turns, ["conv_id"], "text", "turn")


def dedup_newest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"), "value")
    return keep.newest(events, ["user_id"], "at", "event_id")


def dedup_edge(end):
    def query(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", micros(F.col("ts")).alias("at"))
        return end(events, ["user_id", "event_type"], "at", "event_id")

    return query


def id_suffixes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return keep.numbered(orders, "day", ["o_orderkey"], "source_id").select("o_orderkey", "source_id")


def slug_collisions(spark, sf_dir):
    """Unique slugs of all posts, some of which end in a number literally. A post without a date has zeros there, so that all start with ten characters."""
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("0000-00-00"))
    rows = posts(spark, sf_dir).select("id", F.concat(post_slug(day), F.when(F.col("id") % 7 == 0, "-2").otherwise("")).alias("base"))
    return S.unique(rows, "base", ["id"], stem=10).select("id", "slug")


def owner_mode(spark, sf_dir):
    return keep.mode(table(spark, sf_dir, "conversations").select("role", F.struct("conv_id", "turn").alias("seq")), "role", "seq")


def segment_mode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.first_segment(F.col("url")).alias("segment"), "page_id")
    return keep.mode(pages, "segment", "page_id")


def entries(spark, sf_dir):
    path = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("line"), path.alias("path"), "l_partkey", "l_suppkey", "l_returnflag", "l_discount")


def crosspost_antijoin(spark, sf_dir):
    return links.seen_once(entries(spark, sf_dir), "owner", "path").select("owner", "line", "path")


def whitelist(spark, sf_dir):
    rows = entries(spark, sf_dir)
    allowed = rows.where("l_discount >= 0.09").select("owner", "path")
    return links.guarded_whitelist(rows, allowed, "owner", "path", F.col("l_returnflag") == "R").select("owner", "line")


def reshare_rows(spark, sf_dir, text):
    rows = posts(spark, sf_dir).withColumn("seq", F.col("id"))
    return rows.select(
        "id", "seq", (F.col("id") % 3 != 0).alias("reshare"), (F.col("id") % 2 == 0).alias("own"), F.when(F.col("id") % 11 == 1, "").otherwise("profile").alias("segment"),
        F.when(F.col("lang") == "en", "words").otherwise("").alias("commentary"), F.when(F.col("id") % 5 == 0, "https://f.example/1").otherwise("").alias("target"),
        text.alias("text"))


def reshare_pairs(spark, sf_dir):
    """Pairs by the first 12 characters, as the SQL of this name has them; `reshare_text_pairs` has those by whole texts."""
    return links.reshare_states(reshare_rows(spark, sf_dir, F.substring("content_text", 1, 12))).select("id", "state", "other_id")


def reshare_text_pairs(spark, sf_dir):
    return links.reshare_states(reshare_rows(spark, sf_dir, F.col("content_text"))).select("id", "state", "other_id")


def asof_thread(spark, sf_dir):
    """Replies (errors) whose latest anchor of the same user within 72 hours, strictly before, is their own (a signup, not a view)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"))
    anchors = events.where("event_type in ('signup', 'view')").withColumn("own", F.col("event_type") == "signup").withColumn("anchor_id", F.col("event_id"))
    found = asof.latest_before(events.where("event_type = 'error'").select("event_id", "user_id", "at"), anchors, "user_id", "at", "event_id", ["anchor_id", "own"], REPLY_GAP, strict=True)
    return found.where("own").select("event_id", "anchor_id", "gap")


def asof_comment(spark, sf_dir):
    """Every comment (click) with the latest post (purchase) of its user at or before it, at most 7 days ago; null if none."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"))
    made = events.where("event_type = 'purchase'").withColumn("post_id", F.col("event_id"))
    found = asof.latest_before(events.where("event_type = 'click'").select("event_id", "user_id", "at"), made, "user_id", "at", "event_id", ["post_id"], COMMENT_GAP, strict=False)
    return found.select("event_id", "post_id", "gap")


def comments_and_posts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    made = pages.where("page_id % 2 = 0").groupBy(U.post_key(F.col("url")).alias("key")).agg(F.max("page_id").alias("post_id"))  # the last one wins
    mark = F.when(F.col("url").contains("?"), "&comment_id=9&eid=1").otherwise("?comment_id=9&eid=1")
    comments = pages.where("page_id % 3 <> 1").select("page_id", U.post_key(F.concat("url", mark)).alias("key"))
    return comments, made


def comment_parents(spark, sf_dir):
    comments, made = comments_and_posts(spark, sf_dir)
    return comments.join(made, "key").select("page_id", "post_id")


def external_comments(spark, sf_dir):
    comments, made = comments_and_posts(spark, sf_dir)
    return comments.join(made, "key", "left_anti").select("page_id", "key")


def caps_per_kind(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return capped(events, "event_type", [F.asc("event_id")], {"view": 50, "click": 20, "error": 0})


def counts_with_hints(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("found"))
    hint = F.when(F.col("id") % 9 == 0, "many").otherwise((F.col("id") % 12).cast("string")).try_cast("long")
    return posts(spark, sf_dir).select("id", F.coalesce(hint, F.lit(0)).alias("hint")).join(counts, "id", "left").select("id", F.greatest(F.coalesce("found", F.lit(0)), F.col("hint")).alias("comment_count"))


def merge_inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"), (F.col("o_custkey") % 10).alias("count"))
    old = orders.where("key % 2 = 0")
    new = orders.where("key % 3 = 0").select("key", F.lit("N").alias("status"), F.when(F.col("key") % 4 == 0, "").otherwise(F.concat("note", F.lit("!"))).alias("note"), F.lit(5).cast("long").alias("count"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return old, new.withColumn("status", F.concat("status", F.col("seq").cast("string"))).withColumn("id", F.when(F.col("key") % 30 == 0, "").otherwise(F.col("key").cast("string")))


def merge_insert(spark, sf_dir):
    old, new = merge_inputs(spark, sf_dir)
    return merge.insert_absent(old.withColumn("id", F.col("key").cast("string")), new.select("key", "status", "note", "count", "seq", "id"), ["key"], "seq", "id").drop("id")


def merge_update(spark, sf_dir):
    old, new = merge_inputs(spark, sf_dir)
    return merge.update_fields(old, new, ["key"], "seq", ["status"], ["note"], ["count"])


#: Rows of a file of the tables that merges by files change, and the share of keys that they change: those at the end.
FILE_ROWS, CHANGED_FROM = 500, 0.8


def by_files(spark, sf_dir, apply):
    """A merge of the rows with the largest keys into a table of files; the rows of the version that it makes."""
    old, new = merge_inputs(spark, sf_dir)
    old, folder = old.withColumn("id", F.col("key").cast("string")), f"{shared_dir(spark)}/table-{uuid4().hex}"
    filetable.create(old, folder, "key", FILE_ROWS)
    most = new.agg(F.max("key")).first()[0] or 0
    filetable.merge(spark, folder, "key", new.where(F.col("key") > int(most * CHANGED_FROM)), apply, FILE_ROWS)
    return filetable.read(spark, folder).drop("id")


def merge_files_update(spark, sf_dir):
    return by_files(spark, sf_dir, lambda old, new: merge.update_fields(old, new, ["key"], "seq", ["status"], ["note"], ["count"]))


def merge_files_upsert(spark, sf_dir):
    return by_files(spark, sf_dir, lambda old, new: merge.upsert(old, new, ["key"], "seq"))


def merge_actions(spark, sf_dir):
    old, new = merge_inputs(spark, sf_dir)
    return merge.actions(old, keep.first(new, ["key"], "seq"), ["key"])


def profile_links(spark, sf_dir):
    """Names to URLs: what is stored gives way to posts, and these to comments."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Name "), (F.col("c_custkey") % 400).cast("string")).alias("name"))
    part = lambda rank, cond: customers.where(cond).select("name", F.concat(F.lit(f"https://p{rank}.example/"), F.col("c_custkey").cast("string")).alias("url"), F.struct(F.lit(rank).alias("rank"), "c_custkey").alias("seq"))
    every = part(0, "c_custkey % 2 = 0").unionByName(part(1, "c_custkey % 3 = 0")).unionByName(part(2, "c_custkey % 5 = 0"))
    return keep.last(every, ["name"], "seq").select("name", "url")


def tags_once(spark, sf_dir):
    """One tag of each slug; the first name wins, empty slugs are skipped."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"), F.lower(F.regexp_replace("p_type", r"[^A-Za-z0-9]+", "-")).alias("slug"))
    return keep.first(names.where("slug <> ''"), ["slug"], "p_partkey").select("slug", "name")


def cascade_delete(spark, sf_dir):
    gone = posts(spark, sf_dir).where("source = 2").select(F.col("id").alias("conv_id"))
    left = merge.delete_parents(table(spark, sf_dir, "conversations"), gone, "conv_id")
    return left.groupBy("conv_id").agg(F.count("*").alias("turns"))


def replace_chunks(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 100).alias("post_id"))
    new = old.where("post_id % 10 = 0 and chunk_id >= 100").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "post_id")
    return merge.replace_children(old, new, "post_id")


def reaction_counts(spark, sf_dir):
    """Counts by URL, else by key; zeros count as none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.same_page(F.col("url")).alias("key"))
    counts = pages.where("page_id % 2 = 0").groupBy("url").agg(F.max(F.col("page_id") % 7).alias("n"))
    by_key = pages.where("page_id % 5 <> 0").groupBy("key").agg(F.max(F.col("page_id") % 11).alias("k"))
    joined = pages.join(counts, "url", "left").join(by_key, "key", "left")
    return joined.select("page_id", F.coalesce(F.nullif("n", F.lit(0)), F.nullif("k", F.lit(0)), F.lit(0)).alias("reactions"))


def first_attachment(spark, sf_dir):
    """The first line of an order as its link, for orders without 'media' (a line returned)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    media = lines.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return keep.first(lines, ["l_orderkey"], "l_linenumber", "l_partkey").join(media, "l_orderkey", "left_anti").select("l_orderkey", "l_partkey")


def display_names(spark, sf_dir):
    """A profile's known name, else its slug made readable."""
    slug = F.concat(F.lit("max.muster"), (F.col("c_custkey") % 50).cast("string"))
    people = table(spark, sf_dir, "customer").select("c_custkey", slug.alias("slug"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("max.muster"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"))
    return people.join(F.broadcast(known), "slug", "left").select("c_custkey", F.coalesce("name", humanise(F.col("slug"))).alias("name"))  # nations are 25


def prefix_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    names = pages.where("page_id % 4 = 0").select(F.regexp_extract("url", r"^([a-z]+://[^/]+/[a-z]+)", 1).alias("prefix"), F.concat(F.lit("name"), F.col("page_id").cast("string")).alias("name"))
    return links.named_by_prefix(pages, "url", names, "prefix", "name", "page_id")


def original_posts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://f.example/p/"), F.col("doc_id").cast("string"))).otherwise("").alias("source_url"), F.col("doc_id").cast("string").alias("source_id"))
    target = F.floor(F.col("id") / 2)
    reshares = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 < 2, F.concat(F.lit("https://f.example/p/"), target.cast("string"))).otherwise(F.concat(F.lit("https://f.example/u/posts/"), target.cast("string"), F.lit("/x"))).alias("reshared_url"))
    return links.originals(reshares, rows)


def key_probe(spark, sf_dir):
    """The first cache entry among a page's URL, its canonical form and its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    keys = [F.col("url"), U.same_page(F.col("url")), U.path(F.col("url"))]
    cache = pages.where("page_id % 3 = 0").select(F.explode(F.array(F.when(F.col("page_id") % 2 == 0, F.col("url")), U.path(F.col("url")))).alias("key"), "page_id").where("key is not null").groupBy("key").agg(F.min("page_id").alias("hit"))
    return links.by_first_key(pages, "page_id", keys, cache, "key", "hit", "cached").select("page_id", "cached")


def archive_files(spark, sf_dir):
    """A media name's file by name, else by stem; the first in the listing."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("img"), (F.col("p_partkey") % 700).cast("string")).alias("stem"))
    files = parts.where("p_partkey % 3 = 0").select(F.concat("stem", F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".png")).alias("file"), "p_partkey", "stem")
    listing = files.select(F.explode(F.array("file", "stem")).alias("key"), F.struct("p_partkey", "file").alias("at")).groupBy("key").agg(F.min("at").alias("at"))
    names = parts.select("p_partkey", F.concat("stem", F.lit(".jpg")).alias("name"), "stem")
    return links.by_first_key(names, "p_partkey", [F.col("name"), F.col("stem")], listing, "key", "at", "found").select("p_partkey", F.col("found.file").alias("file"))


def titles_or_slugs(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.concat(F.lit("doc-"), ((F.col("o_orderkey") * k) % 1500).cast("string")) for k in (1, 7)])).alias("slug"))
    titles = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.substring("text", 1, 20).alias("title"))
    return cited.join(titles, "slug", "left").select("o_orderkey", "slug", F.coalesce("title", "slug").alias("title"))


def cache_preference(spark, sf_dir):
    """The answer that a cache gives for each question: the exact model's, else its family's, else the premium one; then the most used."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("question"), F.concat(F.lit("base-"), (F.col("event_id") % 5).cast("string")).alias("model"), "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("hits"))
    events = events.withColumn("model", F.when(F.col("event_id") % 3 == 0, "premium").otherwise(F.col("model"))).where("question % 4 <> 1 or model <> 'base-3'")
    rank = F.when(F.col("model") == "base-3", 1).when(F.col("model").startswith("base"), 2).otherwise(3)
    return keep.first(events.withColumn("rank", rank).withColumn("used", -F.col("hits")), ["question"], "rank", "used", "event_id").select("question", "model", "event_id")


def network_threads(spark, sf_dir):
    """Vectors as posts of four networks, an hour apart in the order of a digest; pairs within 48 hours and a cosine distance of 0.75."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("source"), ((F.col("vec_id") * 7919) % 100_003 * 600).alias("at"), "embedding")
    return threads.across_networks(rows, 48 * 3600, 0.75)


QUERIES = {
    "network_threads": network_threads,
    "dedup_longest": dedup_longest, "dedup_newest": dedup_newest, "dedup_first": dedup_edge(keep.first), "dedup_last": dedup_edge(keep.last), "id_suffixes": id_suffixes, "slug_collisions": slug_collisions,
    "owner_mode": owner_mode, "segment_mode": segment_mode, "crosspost_antijoin": crosspost_antijoin, "whitelist_semijoin_guarded": whitelist, "reshare_pairs": reshare_pairs, "reshare_text_pairs": reshare_text_pairs,
    "asof_thread_anchor": asof_thread, "asof_comment_to_post": asof_comment, "comment_parent_match": comment_parents, "comment_external_antijoin": external_comments, "caps_per_kind": caps_per_kind,
    "counts_with_hints": counts_with_hints, "merge_insert_only": merge_insert, "merge_update_fieldwise": merge_update, "merge_files_update": merge_files_update, "merge_files_upsert": merge_files_upsert, "merge_dry_run": merge_actions, "profile_link_merge": profile_links, "tag_get_or_create": tags_once,
    "cascade_delete": cascade_delete, "chunk_replace": replace_chunks, "reaction_counts_two_keys": reaction_counts, "first_attachment": first_attachment, "display_names": display_names, "prefix_names": prefix_names,
    "original_posts": original_posts, "cache_key_probe": key_probe, "archive_file_by_stem": archive_files, "cited_titles": titles_or_slugs, "cache_preference": cache_preference,
}

_E = "e as (select event_id, user_id, event_type, epoch_us(ts) as at from events)"
_ENTRIES = "e as (select l_orderkey as owner, l_linenumber as line, l_partkey || '/' || l_quantity::int as path, l_returnflag, l_discount from lineitem)"
_PAGE = "p as (select page_id, regexp_replace(url, '#.*$', '') as url from pages)"
_KEYS = f"{_PAGE}, made as (select url as key, max(page_id) as post_id from p where page_id % 2 = 0 group by 1), comments as (select page_id, url as key from p where page_id % 3 <> 1)"
_SAME = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '#.*$', '')), '^https?://(www\\.|m\\.)?', ''), '/+\\?', '?'), '/+$', '')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_OLD = "o as (select o_orderkey as key, o_orderstatus as status, o_orderpriority as note, o_custkey % 10 as count from orders), old as (select * from o where key % 2 = 0)"
_FLAGS = f"""{POSTS}, r as (select id, id % 3 <> 0 as reshare, id % 2 = 0 as own, case when id % 11 = 1 then '' else 'profile' end as segment, lang = 'en' as words, id % 5 = 0 as target, substr(content_text, 1, 12) as text from posts),
    f as (select *, reshare and own and (words or target) as own_flag, reshare and not own as other_flag from r),
    t as (select text, min(id) filter (own_flag) as first_own, max(id) filter (other_flag) as last_other from f where own_flag or other_flag group by 1)"""
ORACLE_SQL = {
    "network_threads": """with p as (select vec_id as id, vec_id % 4 as source, (vec_id * 7919) % 100003 * 600 as at, embedding::double[] as v from embeddings),
        d as (select a.id as a, b.id as b, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) + 0.0 as distance from p a, p b
            where a.source <> b.source and b.at - a.at <= 172800 and (a.at < b.at or (a.at = b.at and a.id < b.id))) select a, b, distance from d where distance <= 0.75""",
    "dedup_longest": "select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id order by length(text) desc, turn) = 1",
    "dedup_newest": "select user_id, event_id, epoch_us(ts) as at, value from events qualify row_number() over (partition by user_id order by ts desc, event_id) = 1",
    "dedup_first": f"with {_E} select user_id, event_type, event_id, e.at as \"at\" from e qualify row_number() over (partition by user_id, event_type order by e.at, event_id) = 1",
    "dedup_last": f"with {_E} select user_id, event_type, event_id, e.at as \"at\" from e qualify row_number() over (partition by user_id, event_type order by e.at desc, event_id desc) = 1",
    "id_suffixes": "with o as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') as day, row_number() over (partition by o_orderdate::date order by o_orderkey) as k from orders) select o_orderkey, day || case when k > 1 then '_' || k else '' end as source_id from o",
    "owner_mode": "select role, count(*) as n from conversations group by 1 order by n desc, min((conv_id, turn)) limit 1",
    "segment_mode": "with s as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/+([^/?#]+)', 1) as segment from pages) select segment, count(*) as n from s where segment <> '' group by 1 order by n desc, min(page_id) limit 1",
    "crosspost_antijoin": f"with {_ENTRIES} select owner, line, path from e where path not in (select path from e group by 1 having count(distinct owner) > 1)",
    "whitelist_semijoin_guarded": f"""with {_ENTRIES}, w as (select distinct owner, path from e where l_discount >= 0.09), m as (select e.owner, line, l_returnflag = 'R' or w.path is not null as fits from e left join w on w.owner = e.owner and w.path = e.path),
        g as (select *, bool_or(fits) over (partition by owner) as any_fit from m) select owner, line from g where fits or not any_fit""",
    "reshare_pairs": f"""with {_FLAGS} select id, case when not reshare then 1 when own and not own_flag then 2 when own and id > first_own then 3 when own and last_other is not null then 4 when own and target then 5 when own then 6
        when first_own is not null and id = last_other then 9 when segment = '' then 8 else 7 end as state, case when state = 4 then last_other end as other_id from f left join t on t.text = f.text""",
    "asof_thread_anchor": f"""with {_E}, a as (select *, event_type = 'signup' as own from e where event_type in ('signup', 'view')), r as (select * from e where event_type = 'error')
        select r.event_id, a.event_id as anchor_id, r.at - a.at as gap from r asof join a on r.user_id = a.user_id and r.at > a.at where a.own and r.at - a.at <= {REPLY_GAP}""",
    "asof_comment_to_post": f"""with {_E}, a as (select * from e where event_type = 'purchase'), c as (select * from e where event_type = 'click')
        select c.event_id, case when c.at - a.at <= {COMMENT_GAP} then a.event_id end as post_id, case when c.at - a.at <= {COMMENT_GAP} then c.at - a.at end as gap from c asof left join a on c.user_id = a.user_id and c.at >= a.at""",
    "comment_parent_match": f"with {_KEYS} select page_id, post_id from comments join made using (key)",
    "comment_external_antijoin": f"with {_KEYS} select page_id, key from comments where key not in (select key from made)",
    "caps_per_kind": "select event_id, event_type from events qualify row_number() over (partition by event_type order by event_id) <= case event_type when 'view' then 50 when 'click' then 20 when 'error' then 0 else 1e15 end",
    "counts_with_hints": f"with {POSTS}, c as (select conv_id as id, count(*) as found from conversations group by 1) select id, greatest(coalesce(found, 0), case when id % 9 = 0 then 0 else id % 12 end) as comment_count from posts left join c using (id)",
    "merge_insert_only": f"""with {_OLD}, n as (select key, note || '!' as nn, key % 4 = 0 as empty from o where key % 3 = 0)
        select * from old union all select key, 'N1', case when empty then '' else nn end, 5 from n where key % 30 <> 0 and key not in (select key from old)
        union all select key, 'N' || k, case when empty then '' else nn end, 5 from n, (select unnest([1, 2]) as k) where key % 30 = 0""",
    "merge_update_fieldwise": f"with {_OLD} select key, case when key % 3 = 0 then 'N2' else status end as status, case when key % 3 = 0 and key % 4 <> 0 then note || '!' else note end as note, case when key % 3 = 0 then greatest(count, 5) else count end as count from old",
    "merge_files_update": f"""with {_OLD}, m as (select *, key % 3 = 0 and key > (select floor(max(key) * {CHANGED_FROM}) from o where key % 3 = 0) as hit from old)
        select key, case when hit then 'N2' else status end as status, case when hit and key % 4 <> 0 then note || '!' else note end as note, case when hit then greatest(count, 5) else count end as count from m""",
    "merge_files_upsert": f"""with {_OLD}, n as (select * from o where key % 3 = 0 and key > (select floor(max(key) * {CHANGED_FROM}) from o where key % 3 = 0))
        select * from old where key not in (select key from n) union all select key, 'N2', case when key % 4 = 0 then '' else note || '!' end, 5 from n""",
    "merge_dry_run": f"with {_OLD} select case when key % 2 = 0 then 'updated' else 'created' end as action, count(*) as n from o where key % 3 = 0 group by 1",
    "profile_link_merge": """with c as (select c_custkey, 'Name ' || (c_custkey % 400) as name from customer), a as (select name, r, c_custkey from c, (select unnest([0, 1, 2]) as r) where (r = 0 and c_custkey % 2 = 0) or (r = 1 and c_custkey % 3 = 0) or (r = 2 and c_custkey % 5 = 0))
        select name, 'https://p' || r || '.example/' || c_custkey as url from a qualify row_number() over (partition by name order by r desc, c_custkey desc) = 1""",
    "tag_get_or_create": "select lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) as slug, arg_min(p_type, p_partkey) as name from part where p_type <> '' group by 1",
    "cascade_delete": f"with {POSTS} select conv_id, count(*) as turns from conversations where conv_id not in (select id from posts where source = 2) group by 1",
    "chunk_replace": "with o as (select vec_id as chunk_id, vec_id % 100 as post_id from embeddings), n as (select chunk_id + 1000000 as chunk_id, post_id from o where post_id % 10 = 0 and chunk_id >= 100) select * from o where post_id not in (select post_id from n) union all select * from n",
    "reaction_counts_two_keys": f"""with p as (select page_id, url, {_SAME} as key from pages), u as (select url, max(page_id % 7) as n from p where page_id % 2 = 0 group by 1), k as (select key, max(page_id % 11) as k from p where page_id % 5 <> 0 group by 1)
        select page_id, coalesce(nullif(n, 0), nullif(k, 0), 0) as reactions from p left join u on u.url = p.url left join k on k.key = p.key""",
    "first_attachment": "select l_orderkey, l_partkey from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1",
    "display_names": "select c_custkey, coalesce(n_name, 'Max Muster' || c_custkey % 50) as name from customer left join nation on n_nationkey = c_custkey % 50",
    "prefix_names": """with n as (select regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)', 1) as prefix, 'name' || page_id as name from pages where page_id % 4 = 0)
        select page_id, arg_min(name, (-length(prefix), name)) as name from pages join n on starts_with(url, prefix) and (length(url) = length(prefix) or substr(url, length(prefix) + 1, 1) in ('/', '?', '#')) where prefix <> '' group by 1""",
    "original_posts": """with r as (select doc_id as id, doc_id // 2 as target, doc_id % 4 < 2 as direct from documents where doc_id % 3 = 0)
        select id, target as original_id from r where target in (select doc_id from documents) and target <> id""",
    "cache_key_probe": f"""with p as (select page_id, url, {_SAME} as same, {_PATH} as path from pages), c as (select key, min(page_id) as hit from (select url as key, page_id from p where page_id % 6 = 0 union all select path, page_id from p where page_id % 3 = 0) group by 1)
        select p.page_id, coalesce(a.hit, b.hit, d.hit) as cached from p left join c a on a.key = p.url left join c b on b.key = p.same left join c d on d.key = p.path and p.path <> ''""",
    "archive_file_by_stem": """with p as (select p_partkey, 'img' || (p_partkey % 700) as stem from part), f as (select p_partkey, stem, stem || case when p_partkey % 2 = 0 then '.jpg' else '.png' end as file from p where p_partkey % 3 = 0)
        select p.p_partkey, coalesce(case when exists (select 1 from f where f.file = p.stem || '.jpg') then p.stem || '.jpg' end, (select arg_min(f.file, f.p_partkey) from f where f.stem = p.stem)) as file from p""",
    "cited_titles": "with c as (select o_orderkey, 'doc-' || ((o_orderkey * k) % 1500) as slug from orders, (select unnest([1, 7]) as k)) select o_orderkey, slug, coalesce(substr(text, 1, 20), slug) as title from c left join documents on slug = 'doc-' || doc_id",
    "cache_preference": """with e as (select user_id % 40 as question, case when event_id % 3 = 0 then 'premium' else 'base-' || (event_id % 5) end as model, event_id, (props->>'$.k')::bigint as hits from events)
        select question, model, event_id from e where question % 4 <> 1 or model <> 'base-3' qualify row_number() over (partition by question order by case when model = 'base-3' then 1 when starts_with(model, 'base') then 2 else 3 end, hits desc, event_id) = 1""",
}
ORACLE_SQL["reshare_text_pairs"] = ORACLE_SQL["reshare_pairs"].replace("substr(content_text, 1, 12)", "content_text")
