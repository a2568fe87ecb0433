"""An inverted index of texts, and ranked keyword search that reads the postings of the question's tokens only.

A row of the postings is a token in one block of documents, with the best score that an occurrence there can give. Blocks are about BLOCK
documents by a digest of their ids, so a token that every text holds is many rows. Rows lie in the order of tokens: a search for
some of them skips the others' row groups. The best scores of a block's tokens bound what its documents can score: the blocks with
the highest bounds are scored first, and of the others only those whose bound reaches the score of the last hit wanted.

Ids are unique. Cases: null and empty texts have no postings; equal scores are ordered by time and id; a question without tokens finds
texts by its pieces; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import holds, holds_any, let, query_tokens, tokens
from lodestone.operators.pages import ranked
from lodestone.session import cut

#: Documents of a block.
BLOCK = 1024
#: What rounding to nine places may add to a score.
SLACK = 1e-9


@dataclass
class InvertedIndex:
    """Postings (token, block, best, posts of id, times and length) and tokens (token, texts, blocks)."""

    postings: DataFrame
    tokens: DataFrame
    stem: Callable[[Column], Column] | None


def lowered(length: Column) -> Column:
    """What the occurrences in a text of so many tokens are divided by."""
    return 1 + F.log(F.greatest(length, F.lit(1)))


def counts(words: Column) -> Column:
    """(token, times) of each distinct word of an array, from runs of equal words in its sorted form."""

    def runs(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.get(w, i - 1).eqNullSafe(F.get(w, i)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(w, i - 1).alias("token"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("times"))))

    return let(F.array_sort(words), runs)


def build(posts: DataFrame, folder: str | None = None, stem: Callable[[Column], Column] | None = None) -> InvertedIndex:
    """The index of `posts` (id, content_text), of their tokens or of these tokens' stems, written to `folder` or else kept in the shared one.

    Tokens are stemmed once each, not once for each occurrence. A text's tokens are counted in its row, and texts are dealt out by blocks, as many
    parts as blocks: what a task holds are the postings of a few blocks, however many texts there are.
    """
    blocks = max(1, -(-posts.count() // BLOCK))
    words = posts.select("id", tokens(F.col("content_text")).alias("words"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    found = words.repartition(blocks, "block").select("id", "block", F.size("words").alias("length"), F.explode(counts(F.col("words"))).alias("c"))
    rows = found.select("id", "block", "length", "c.token", "c.times").groupBy("token", "block").agg(F.collect_list(F.struct("id", "times", "length")).alias("posts"))
    if stem:
        # forms of one stem in one block are put together: their counts in a text are added
        rows = rows.join(stems(rows.select("token").distinct(), stem), "token").select(F.col("stem").alias("token"), "block", F.explode("posts").alias("p"))
        rows = rows.groupBy("token", "block", "p.id", "p.length").agg(F.sum("p.times").alias("times")).groupBy("token", "block").agg(F.collect_list(F.struct("id", "times", "length")).alias("posts"))
    best = F.array_max(F.transform("posts", lambda p: p["times"] / lowered(p["length"])))
    rows = rows.select("token", "block", best.alias("best"), "posts")
    if folder is None:
        rows = cut(rows)
    else:
        rows.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.parquet(f"{folder}/postings")
        rows = posts.sparkSession.read.parquet(f"{folder}/postings")
    known = rows.groupBy("token").agg(F.sum(F.size("posts").cast("long")).alias("texts"), F.count("*").alias("blocks"))
    if folder is None:
        known = cut(known)
    else:
        known.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{folder}/tokens")
        known = posts.sparkSession.read.parquet(f"{folder}/tokens")
    return InvertedIndex(rows, known, stem)


def stems(words: DataFrame, stem: Callable[[Column], Column]) -> DataFrame:
    """(token, stem) of the rows of `words` (token)."""
    return words.withColumn("stem", stem(F.col("token")))


def asked_for(index: InvertedIndex, question: str) -> list[str]:
    """The question's distinct tokens as the index has them."""
    one = index.postings.sparkSession.range(1).select(F.explode(tokens(F.lit(question))).alias("token"))
    one = one.select(index.stem(F.col("token")).alias("token")) if index.stem else one
    return sorted({r.token for r in one.collect()})


def scored(postings: DataFrame) -> DataFrame:
    """(id, keyword_rank) of every text in these rows: its occurrences of their tokens over 1 + ln of its tokens."""
    rows = postings.select(F.inline("posts"))
    return rows.groupBy("id").agg(F.round(F.sum("times") / lowered(F.first("length")), 9).alias("keyword_rank"))


def best_hits(index: InvertedIndex, asked: list[str], most: int) -> tuple[DataFrame, bool]:
    """(id, keyword_rank) of the texts that can be among the `most` best with a token, and whether there are so many."""
    postings = index.postings.where(F.col("token").isin(*asked))
    bounds = postings.groupBy("block").agg(F.sum("best").alias("bound"))
    # each of these blocks has a hit at least, so that `most` of them hold enough
    first = bounds.orderBy(F.desc("bound"), "block").limit(most).select("block")
    sure = scored(postings.join(F.broadcast(first), "block")).orderBy(F.desc("keyword_rank")).limit(most)
    least, n = sure.agg(F.min("keyword_rank"), F.count("*")).first()
    if n < most:
        return scored(postings), False
    open_ = bounds.where(F.col("bound") >= least - SLACK).select("block")
    return scored(postings.join(open_, "block", "left_semi")).where(F.col("keyword_rank") >= least), True


def holding(index: InvertedIndex, posts: DataFrame, question: str) -> DataFrame:
    """The rows of `posts` with the whole question or a piece of four letters in their text, by the tokens that hold its longest runs of letters and digits.

    A piece without such a run is in no token: then, and where tokens are stems, all texts are looked at.
    """
    found = holds(F.col("content_text"), question) | holds_any(F.col("content_text"), query_tokens(question, 4))
    runs = [max(re.findall(r"[^\W_]+", piece), key=len, default="") for piece in [question, *query_tokens(question, 4)]]
    if index.stem or not all(runs) or not question.isascii():
        return posts.where(found)
    names = index.tokens.where(holds_any(F.col("token"), sorted(set(runs)))).select("token")
    ids = index.postings.join(names, "token", "left_semi").select(F.explode("posts.id").alias("id")).distinct()
    return posts.join(ids, "id", "left_semi").where(found)


def keyword(index: InvertedIndex, posts: DataFrame, question: str, most: int) -> DataFrame:
    """Ranked keyword hits of `posts`, whose index this is: texts with a token of the question, best first, then those with a piece of it."""
    asked = asked_for(index, question)
    hits, full = best_hits(index, asked, most) if asked else (None, False)
    fields = ["id", "created_at", "reshared_from_author"]
    if hits is None:
        rows = holding(index, posts, question).select(*fields, F.lit(0.0).alias("keyword_rank"))
    else:
        rows = posts.select(*fields).join(hits.where("keyword_rank > 0"), "id")
        if not full:
            more = holding(index, posts, question).select(*fields).join(hits.select("id"), "id", "left_anti")
            rows = rows.unionByName(more.withColumn("keyword_rank", F.lit(0.0)))
    return ranked(rows, [F.desc("keyword_rank"), F.desc_nulls_last("created_at"), F.desc("id")], most)
