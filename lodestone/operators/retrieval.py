"""Keyword and vector retrieval, fusion of ranked lists and selection across years."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import holds, holds_any, query_tokens, tokens
from lodestone.functions.vectors import cosine_distance
from lodestone.operators.pages import ranked

#: Hits of each list; chunks looked at before they are pooled; hits by date; answers.
FAN_OUT, CHUNKS, BY_DATE, TOP = 25, 100, 12, 10
#: What a repost's score is multiplied by; what a hit by date adds; what each earlier pick of a year takes from the next.
REPOST, DATE_BONUS, YEAR_PENALTY = 0.95, 0.85, 0.10
#: Queries whose vectors are broadcast at once.
QUERY_BLOCK = 1024


def newest() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.desc("id")]


def keyword_rank(text: Column, question: str) -> Column:
    """Occurrences of the question's tokens over 1 + ln of the text's tokens."""
    words = tokens(text)
    asked = F.array_distinct(tokens(F.lit(question)))
    hits = F.size(F.filter(words, lambda w: F.array_contains(asked, w)))
    return F.round(hits / (1 + F.log(F.greatest(F.size(words), F.lit(1)))), 9)


def keyword(posts: DataFrame, question: str, most: int = FAN_OUT) -> DataFrame:
    """Ranked keyword hits: a text with a token of the question, or with a longer one anywhere inside a word."""
    # a text with one of the tokens contains it: a cheap look before texts are cut into tokens
    near = holds_any(F.col("content_text"), query_tokens(question, 1)) | holds(F.col("content_text"), question)
    scored = posts.where(near).withColumn("keyword_rank", keyword_rank(F.col("content_text"), question))
    found = (F.col("keyword_rank") > 0) | holds(F.col("content_text"), question) | holds_any(F.col("content_text"), query_tokens(question, 4))
    return ranked(scored.where(found).select("id", "created_at", "reshared_from_author", "keyword_rank"), [F.desc("keyword_rank"), *newest()], most)


def any_token(posts: DataFrame, question: str, least: int = 3) -> DataFrame:
    """The plain form: texts that hold any token of the question."""
    return posts.where(holds_any(F.col("content_text"), query_tokens(question, least)))


def nearest_chunks(chunks: DataFrame, vector: DataFrame, most: int) -> DataFrame:
    """The `most` chunks (chunk_id, post_id, distance) nearest to the vector of the one row of `vector`."""
    scored = chunks.where("embedding is not null").crossJoin(F.broadcast(vector.limit(1).select(F.col("embedding").alias("asked"))))
    scored = scored.select("chunk_id", "post_id", (F.round(cosine_distance(F.col("embedding"), F.col("asked")), 9) + 0.0).alias("distance"))
    return scored.where("distance is not null").orderBy("distance", "chunk_id").limit(most)


def semantic(posts: DataFrame, chunks: DataFrame, vector: DataFrame, most: int = FAN_OUT, fan_out: int = CHUNKS) -> DataFrame:
    """Posts by their nearest chunk among the `fan_out` nearest ones of all these posts."""
    near = nearest_chunks(chunks.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi"), vector, fan_out)
    pooled = near.groupBy(F.col("post_id").alias("id")).agg(F.min("distance").alias("distance"))
    hits = posts.select("id", "created_at", "reshared_from_author").join(F.broadcast(pooled), "id")  # at most fan_out rows
    return ranked(hits, [F.asc("distance"), F.asc("id")], most)


def by_date(posts: DataFrame, days: list, most: int = BY_DATE) -> DataFrame:
    """The newest posts of these days; a range for each day, so that statistics can prune."""
    on = F.lit(False)
    for day in days:
        start = F.lit(day).cast("date").cast("timestamp_ntz")
        on = on | ((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 day")))
    return ranked(posts.where(on & (F.col("content_text") != "")).select("id", "created_at", "reshared_from_author"), newest(), most)


def fuse(words: DataFrame, vectors: DataFrame, dated: DataFrame | None = None, repost: float = REPOST) -> DataFrame:
    """(id, created_at, score, pos): each list gives a hit half a point less its rank's share; dates give a bonus; reposts are damped.

    `pos` is where a hit came first: list, then rank. The lists are bounded, so all this is a few rows.
    """
    share = 0.5 * (F.col("n") - F.col("rank") + 1) / F.col("n")
    parts = [hits.select("id", "created_at", "reshared_from_author", F.lit(k).alias("list"), "rank", gain.alias("gain")) for k, (hits, gain) in enumerate(((words, share), (vectors, share), (dated, F.lit(DATE_BONUS))), 1) if hits is not None]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("id", "created_at", "reshared_from_author").agg(F.sum("gain").alias("score"), F.min(F.struct("list", "rank")).alias("pos"))
    damped = F.when(F.col("reshared_from_author") != "", F.col("score") * repost).otherwise(F.col("score"))
    return fused.withColumn("score", F.round(damped, 9))


def across_years(hits: DataFrame, top: int = TOP) -> DataFrame:
    """Greedy choice that takes YEAR_PENALTY off a hit's score for each hit of its year chosen before.

    Within a year all hits lose the same, so they are chosen by score, the k-th with k - 1 penalties, until penalties reach the whole
    score; from then on the smallest score loses least and is chosen first. What a year's hits are worth falls from one to the
    next, so one sort of all is the greedy choice, for any `top`.
    """
    year = F.year("created_at")
    paid = round(1 + 1 / YEAR_PENALTY)  # hits of a year that are worth something, and one that is worth nothing
    hits = hits.withColumn("__nth", F.row_number().over(Window.partitionBy(year).orderBy(F.desc("score"), "pos")))
    rest = F.row_number().over(Window.partitionBy(year, F.col("__nth") > paid).orderBy("score", "pos"))
    before = F.when(F.col("__nth") > paid, paid + rest).otherwise(F.col("__nth")) - 1
    before = F.when(year.isNull(), 0).otherwise(before)
    chosen = hits.withColumn("effective", F.round(F.col("score") - YEAR_PENALTY * before * F.col("score"), 9))
    order = [F.desc("effective"), F.desc("score"), F.asc("pos")]
    chosen = chosen.drop("__nth")
    return chosen.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def by_size(vectors: pa.Array) -> dict[int, np.ndarray]:
    """A batch of vectors, all of one size, as a matrix under that size; nothing for an empty batch."""
    sizes = {len(v) for v in vectors}
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sorted(sizes)} numbers")
    return {n: vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for n in sizes}


def first_of(ids: np.ndarray, found: np.ndarray, distance: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, distance): each query's first `most` of the rows `found`, by `distance` (rows by queries) and id, itself left out."""
    for k, query in enumerate(ids):
        near = distance[:, k]
        if len(near) > most + 1:  # the query itself may be among the first; all that tie with the last stay until ids decide
            at = np.flatnonzero(near <= np.partition(near, most)[most])
        else:
            at = np.arange(len(near))
        at = at[found[at] != query]
        at = at[np.lexsort((found[at], near[at]))[:most]]
        yield pa.record_batch({"query_id": np.full(len(at), query), "vec_id": found[at], "distance": near[at]})


def nearest_batch(queries: DataFrame, vectors: DataFrame, most: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, distance, rank): each query's nearest vectors, itself left out.

    Queries are broadcast in blocks of a fixed size. A task multiplies a batch with a block and keeps each query's first `most`;
    one more window over those of all tasks ranks them.
    """
    spark = queries.sparkSession
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    queries, vectors = queries.where(good), vectors.where(good)
    out, after = None, None
    while True:
        rows = (queries if after is None else queries.where(F.col("query_id") > after)).orderBy("query_id").limit(block).collect()
        if not rows:
            break
        after = rows[-1].query_id
        ids = np.array([r.query_id for r in rows])
        shared = spark.sparkContext.broadcast((ids, unit(np.array([r.embedding for r in rows], dtype=np.float64))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            for batch in batches:
                found = batch.column(0).to_numpy(zero_copy_only=False)
                for size, rows in by_size(batch.column(1)).items():
                    if size != asked.shape[1]:
                        raise ValueError(f"vectors of {size} and of {asked.shape[1]} numbers")
                    yield from first_of(ids, found, np.round(1 - unit(rows) @ asked.T, 9) + 0.0, most)

        part = vectors.select("vec_id", "embedding").mapInArrow(search, "query_id bigint, vec_id bigint, distance double")
        out = part if out is None else out.unionByName(part)
        if len(rows) < block:
            break
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def shared_topic(hits: DataFrame, text: str, least: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """(year): the years of hits that share a token with at least `least` hits, if there are as many such hits and as many years."""
    cleaned = F.lower(F.translate(F.col(text), "_-", "  "))
    found = hits.select("id", "created_at", F.explode(F.array_distinct(F.regexp_extract_all(cleaned, F.lit(r"[\p{L}\p{N}]{4,}"), 0))).alias("token"))
    found = found.where(~F.col("token").isin(*stop)) if stop else found
    shared = found.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    topic = found.join(shared, "token", "left_semi").select("id", "created_at").distinct()
    gate = topic.agg(F.count("*").alias("hits"), F.countDistinct(F.year("created_at")).alias("years"))
    years = topic.where("created_at is not null").select(F.year("created_at").cast("long").alias("year")).distinct()
    return years.crossJoin(F.broadcast(gate)).where((F.col("hits") >= least) & (F.col("years") >= least)).select("year")
