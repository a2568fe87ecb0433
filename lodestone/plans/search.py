"""Search: keyword, vector, date and hybrid retrieval."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions.text import holds
from lodestone.operators import inverted, vector_index
from lodestone.operators import retrieval as R
from lodestone.plans.views import CHUNKS, POSTS, STAMP, chunks, public_posts, stamp
from lodestone.session import table

QUESTION, PHRASE, VECTOR, DAYS = "there and heed nthandin pour nicht", "there", 0, ["1997-06-01", "1998-09-15", "1996-03-07"]
#: A question of which no text holds many words, and one with a piece that is inside of words only.
RARE, INSIDE = "eresan nthandin", "threin zz-nope"
TOPIC = ("that", "this", "with", "from", "have", "their", "about")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR).select("embedding")


def keyword_ilike(spark, sf_dir):
    return public_posts(spark, sf_dir).where(holds(F.col("content_text"), "100% ") | holds(F.col("content_text"), PHRASE)).select("id", "lang")


def keyword_token_or(spark, sf_dir):
    hits = R.any_token(public_posts(spark, sf_dir), QUESTION)
    return hits.orderBy(*R.newest()).limit(R.FAN_OUT).select("id", stamp(F.col("created_at")).alias("created"))


def keyword_hits(spark, sf_dir):
    return R.keyword(public_posts(spark, sf_dir), QUESTION)


def keyword_ranked(spark, sf_dir):
    return keyword_hits(spark, sf_dir).select("id", "keyword_rank", F.col("rank").cast("long").alias("place"))


def keyword_by_index(question, most=R.FAN_OUT):
    def hits(spark, sf_dir):
        posts = public_posts(spark, sf_dir)
        found = inverted.keyword(inverted.build(posts), posts, question, most)
        return found.select("id", "keyword_rank", F.col("rank").cast("long").alias("place"))

    return hits


def semantic_topk(spark, sf_dir):
    """The nearest 50 chunks, with their posts read again by rank."""
    near = R.nearest_chunks(chunks(spark, sf_dir), asked(spark, sf_dir), 50)
    posts = public_posts(spark, sf_dir).select("id", "lang", F.substring("content_text", 1, 200).alias("snippet"))
    return near.join(posts, F.col("id") == F.col("post_id")).select("chunk_id", "post_id", "distance", "lang", "snippet")


def semantic_hits(spark, sf_dir):
    return R.semantic(public_posts(spark, sf_dir), chunks(spark, sf_dir), asked(spark, sf_dir))


def semantic_maxpool(spark, sf_dir):
    return semantic_hits(spark, sf_dir).select("id", "distance", F.col("rank").cast("long").alias("place"))


def vectors(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings")
    return every.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), every


def semantic_batch(spark, sf_dir):
    queries, every = vectors(spark, sf_dir)
    return R.nearest_batch(queries, every, 10)


def semantic_indexed(spark, sf_dir):
    """The neighbours of semantic_batch from the index of cells, in exact mode."""
    queries, every = vectors(spark, sf_dir)
    return vector_index.search(vector_index.build(every), queries, 10, exact=True)


def semantic_index_recall(spark, sf_dir):
    """Of each query's ten nearest vectors those that the probed cells hold, and how many vectors these cells have."""
    queries, every = vectors(spark, sf_dir)
    index = vector_index.build(every)
    near, true = vector_index.search(index, queries, 10), vector_index.search(index, queries, 10, exact=True)
    found = true.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    found = found.groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("hit").alias("found"))
    return found.join(vector_index.rows_read(index, queries), "query_id")


def retrieval_recall(spark, sf_dir):
    """Mean rank of the first neighbour with the query's label, and how often that is the first, or among three."""
    queries, every = vectors(spark, sf_dir)
    label = every.select("vec_id", "label")
    near = R.nearest_batch(queries, every, 50).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    first = near.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("place"))
    share = lambda k: F.round(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("queries"), F.round(F.avg("place"), 6).alias("mean_rank"), share(1).alias("hit_1"), share(3).alias("hit_3"))


def date_hits_list(spark, sf_dir):
    return R.by_date(public_posts(spark, sf_dir), DAYS)


def date_hits(spark, sf_dir):
    return date_hits_list(spark, sf_dir).select("id", stamp(F.col("created_at")).alias("created"), F.col("rank").cast("long").alias("place"))


def fused(spark, sf_dir, repost=R.REPOST):
    return R.fuse(keyword_hits(spark, sf_dir), semantic_hits(spark, sf_dir), date_hits_list(spark, sf_dir), repost)


def hybrid_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("id", "score", F.col("pos.list").cast("long").alias("list"), F.col("pos.rank").cast("long").alias("list_rank"))


def repost_undamped(spark, sf_dir):
    return fused(spark, sf_dir, 1.0).where("reshared_from_author <> ''").select("id", "score", F.round(F.col("score") * R.REPOST, 9).alias("damped"))


def hybrid_mmr(spark, sf_dir):
    return R.across_years(fused(spark, sf_dir)).select("id", "score", "effective", F.col("place").cast("long").alias("place"))


def question_texts(spark, sf_dir):
    """Questions that name dates in each form, made from orders."""
    orders = table(spark, sf_dir, "orders")
    day = lambda k, form: F.date_format(F.date_add("o_orderdate", k), form)
    return orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("seen "), day(0, "yyyy-MM-dd"), F.lit(" or "), day(1, "d.M.yyyy"), F.lit(", not 2022-02-31, "), day((F.col("o_orderkey") % 2).cast("int"), "MMM d, yyyy"), F.lit("?")).alias("question"))


def date_extract(spark, sf_dir):
    found = dates.mentioned(F.col("question"))
    return question_texts(spark, sf_dir).select("id", F.array_join(F.transform(found, lambda d: d.cast("string")), ",").alias("days"))


def topic_timeline(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir).select("id", "created_at")
    texts = public_posts(spark, sf_dir).select("id", F.substring("content_text", 1, 500).alias("snippet"))
    return R.shared_topic(texts.join(F.broadcast(hits), "id"), "snippet", 3, TOPIC)


def hit_projection(spark, sf_dir):
    """A hit's snippet is its own text, else the reshared one; an excerpt only where there are both."""
    rows = public_posts(spark, sf_dir).withColumn("own", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("content_text"))).withColumn("reshared", F.when(F.col("reshared_from_author") != "", F.col("lang")).otherwise(""))
    snippet = F.when(F.col("own") != "", F.substring("own", 1, 500)).otherwise(F.substring("reshared", 1, 500))
    excerpt = F.when((F.col("own") != "") & (F.col("reshared") != ""), F.substring("reshared", 1, 300)).otherwise("")
    return rows.select("id", snippet.alias("snippet"), excerpt.alias("excerpt"))


QUERIES = {
    "keyword_ilike": keyword_ilike, "keyword_token_or": keyword_token_or, "keyword_ranked": keyword_ranked, "semantic_topk": semantic_topk, "semantic_maxpool": semantic_maxpool,
    "semantic_batch": semantic_batch, "retrieval_recall": retrieval_recall, "date_hits": date_hits, "hybrid_fusion": hybrid_fusion, "repost_dampened": repost_undamped,
    "hybrid_mmr": hybrid_mmr, "date_extract": date_extract, "topic_timeline_years": topic_timeline, "hit_projection": hit_projection,
    "keyword_indexed": keyword_by_index(QUESTION), "keyword_indexed_rare": keyword_by_index(RARE), "keyword_indexed_inside": keyword_by_index(INSIDE, 200),
    "semantic_indexed": semantic_indexed, "semantic_index_recall": semantic_index_recall,
}

_LOW = "lower(content_text)"
_TOKENS = f"regexp_extract_all({_LOW}, '[\\p{{L}}\\p{{N}}]+')"
_PIECES = lambda question, least: "(" + " or ".join(["false"] + [f"contains({_LOW}, '{t.lower()}')" for t in question.split() if len(t) >= least]) + ")"
_ANY = lambda least: _PIECES(QUESTION, least)
_NEW = "created_at desc nulls last, id desc"
_DISTANCE = "round(1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 9) + 0.0"


def _keyword(question: str, most: int = R.FAN_OUT) -> str:
    asked = "[" + ", ".join(f"'{t}'" for t in re.findall(r"[^\W_]+", question.lower())) + "]"
    return f"""kw as (select *, row_number() over (order by keyword_rank desc, {_NEW}) as rank, count(*) over () as n from (
    select id, created_at, reshared_from_author, round(len(list_filter(toks, lambda w: list_contains({asked}, w))) / (1 + ln(greatest(len(toks), 1))), 9) as keyword_rank
    from (select *, {_TOKENS} as toks from public_posts)
    where keyword_rank > 0 or contains({_LOW}, '{question}') or {_PIECES(question, 4)} order by keyword_rank desc, {_NEW} limit {most}))"""


_KEYWORD = _keyword(QUESTION)
_NEAR = f"near as (select a.chunk_id, a.post_id, {_DISTANCE} as distance from chunks a, (select embedding from embeddings where vec_id = {VECTOR}) b {{}} order by distance, chunk_id limit {{}})"
_SEMANTIC = (
    _NEAR.format("where a.post_id in (select id from public_posts)", R.CHUNKS)
    + f""", sem as (select p.id, p.created_at, p.reshared_from_author, d.distance, row_number() over (order by d.distance, p.id) as rank, count(*) over () as n
    from (select post_id, min(distance) as distance from near group by 1) d join public_posts p on p.id = d.post_id qualify rank <= {R.FAN_OUT})"""
)
_DAYS = f"""dated as (select id, created_at, reshared_from_author, row_number() over (order by {_NEW}) as rank from public_posts
    where created_at::date in ({", ".join(f"date '{d}'" for d in DAYS)}) and content_text <> '' qualify rank <= {R.BY_DATE})"""
_FUSED = f"""{POSTS}, {CHUNKS}, {_KEYWORD}, {_SEMANTIC}, {_DAYS},
    gains as (select id, created_at, reshared_from_author, 1 as list, rank, 0.5::double * (n - rank + 1) / n as gain from kw
        union all select id, created_at, reshared_from_author, 2, rank, 0.5::double * (least(n, {R.FAN_OUT}) - rank + 1) / least(n, {R.FAN_OUT}) from sem
        union all select id, created_at, reshared_from_author, 3, rank, {R.DATE_BONUS}::double from dated),
    summed as (select id, created_at, reshared_from_author, sum(gain) as raw, min(list * 1000 + rank) as pos from gains group by 1, 2, 3),
    fused as (select *, round(case when reshared_from_author <> '' then raw * {R.REPOST}::double else raw end, 9) as score from summed)"""
_BATCH = f"""q as (select a.vec_id as query_id, b.vec_id, {_DISTANCE} as distance from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from q)"""
ORACLE_SQL = {
    "keyword_ilike": f"with {POSTS} select id, lang from public_posts where contains({_LOW}, '100% ') or contains({_LOW}, '{PHRASE}')",
    "keyword_token_or": f"with {POSTS} select id, {STAMP.format('created_at')} as created from public_posts where {_ANY(3)} order by {_NEW} limit {R.FAN_OUT}",
    "keyword_ranked": f"with {POSTS}, {_KEYWORD} select id, keyword_rank, rank as place from kw",
    "keyword_indexed": f"with {POSTS}, {_KEYWORD} select id, keyword_rank, rank as place from kw",
    "keyword_indexed_rare": f"with {POSTS}, {_keyword(RARE)} select id, keyword_rank, rank as place from kw",
    "keyword_indexed_inside": f"with {POSTS}, {_keyword(INSIDE, 200)} select id, keyword_rank, rank as place from kw",
    "semantic_indexed": f"with {_BATCH} select * from ranked where rank <= 10",
    "semantic_topk": f"with {POSTS}, {CHUNKS}, {_NEAR.format('', 50)} select chunk_id, post_id, distance, lang, substr(content_text, 1, 200) as snippet from near join public_posts on id = post_id",
    "semantic_maxpool": f"with {POSTS}, {CHUNKS}, {_SEMANTIC} select id, distance, rank as place from sem",
    "semantic_batch": f"with {_BATCH} select * from ranked where rank <= 10",
    "retrieval_recall": f"""with {_BATCH}, f as (select query_id, min(rank) filter (x.label = y.label) as place from ranked r join embeddings x on x.vec_id = r.vec_id join embeddings y on y.vec_id = r.query_id where rank <= 50 group by 1)
        select count(*) as queries, round(avg(place), 6) as mean_rank, round(avg((coalesce(place, 99) <= 1)::int), 6) as hit_1, round(avg((coalesce(place, 99) <= 3)::int), 6) as hit_3 from f""",
    "date_hits": f"with {POSTS}, {_DAYS} select id, {STAMP.format('created_at')} as created, rank as place from dated",
    "hybrid_fusion": f"with {_FUSED} select id, score, pos // 1000 as list, pos % 1000 as list_rank from fused",
    "repost_dampened": f"with {_FUSED} select id, round(raw, 9) as score, round(round(raw, 9) * {R.REPOST}::double, 9) as damped from fused where reshared_from_author <> ''",
    "hybrid_mmr": f"""with {_FUSED}, e as (select *, round(score - {R.YEAR_PENALTY}::double * case when created_at is null then 0 else row_number() over (partition by year(created_at) order by score desc, pos) - 1 end * score, 9) as effective from fused)
        select id, score, effective, row_number() over (order by effective desc, score desc, pos) as place from e order by place limit {R.TOP}""",
    "date_extract": """with d as (select o_orderkey as id, o_orderdate::date as a, o_orderdate::date + 1 as b, o_orderdate::date + (o_orderkey % 2)::int as c from orders)
        select id, a || ',' || b || case when c not in (a, b) then ',' || c else '' end as days from d""",
    "topic_timeline_years": f"""with {POSTS}, {_KEYWORD}, t as (select distinct kw.id, kw.created_at, unnest(regexp_extract_all(lower(translate(substr(content_text, 1, 500), '_-', '  ')), '[\\p{{L}}\\p{{N}}]{{4,}}')) as token from kw join public_posts p on p.id = kw.id),
        s as (select * from t where token not in ({", ".join(f"'{w}'" for w in TOPIC)})), topic as (select distinct id, created_at from s where token in (select token from s group by 1 having count(*) >= 3))
        select distinct year(created_at)::bigint as year from topic where created_at is not null and (select count(*) >= 3 and count(distinct year(created_at)) >= 3 from topic)""",
    "hit_projection": f"""with {POSTS}, r as (select id, case when id % 3 = 0 then '' else content_text end as own, case when reshared_from_author <> '' then lang else '' end as reshared from public_posts)
        select id, case when own <> '' then substr(own, 1, 500) else substr(reshared, 1, 500) end as snippet, case when own <> '' and reshared <> '' then substr(reshared, 1, 300) else '' end as excerpt from r""",
}
