"""Ranked lexical search: a hierarchical tree of maxima over document ranges for each term, descended best bound first.

The index deals documents to shards of at most SHARD documents and POSTINGS postings, as they come in a partition. A shard has, for each of
its terms, the documents that hold it with their impacts (what an occurrence counts for, without the term's weight), and the largest impact in
each range of 64 and of 512 documents and in the whole shard. The weighted sum of an item's maxima bounds the score of every document of
a range. A search opens the range with the highest bound, then the next, and ends when no bound reaches the k-th score found; ranges whose
bound equals it are opened, as an equal score with a smaller id goes before. The same holds between shards: the shard with an item's highest
bound is searched first, and in the others only what can reach the k-th score found there.

At scale: texts are read twice where they lie (once for N and L) and never shuffled; a shard is one row of a few MB,
whatever a term's number of documents, and the unit of work. An item sends at most k hits a shard on, which are cut down again before they
meet. Items go in blocks of about ENTRIES of their terms, of which one at a time is gathered and broadcast; each takes three passes over the index,
the first over terms and shard maxima alone.

Cases: null and empty texts have no terms: such documents count nowhere and are never found, such items have no rows; items that repeat an
id are ranked each; documents that repeat an id are found each; a missing doc_id orders last; fewer than k hits are all hits above 0;
empty tables give no rows; a very long text is counted in pieces; further columns aren't read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a term as they are, in lower case, and blanks for all others. A byte of 128 or more is part of a letter that isn't ASCII.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents in a range of each level from below; the last is a whole shard.
RANGES = (64, 512, 4096)
SHARD, POSTINGS = RANGES[-1], 1 << 20
#: Bytes of a text that are counted at once; terms of items in a block; hits.
PIECE, ENTRIES, TOP = 1 << 22, 200_000, 10
#: The share of a document's length in what lowers its impacts, in percent; the impact's scale, and what an occurrence and that length count for.
LENGTH, SCALE, OFTEN, LONG = 75, 1_000_000_000, 1000, 8

_LEVEL = "struct<df:array<int>,node:array<smallint>,most:array<int>>"
INDEX = f"shard bigint, docs array<bigint>, terms array<binary>, df array<int>, at array<smallint>, impact array<int>, levels array<{_LEVEL}>, tops array<int>"


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a piece of it at a time."""
    data, start = data.translate(FOLDED), 0
    while len(data) - start > PIECE and (end := data.find(b" ", start + PIECE)) >= 0:
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def counted(data: bytes) -> Counter:
    """How often a text has each of its terms."""
    found = Counter()
    for piece in pieces(data):
        found.update(piece)
    return found


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of texts how many have a term, and how many terms they have together."""
    for batch in batches:
        n = [sum(map(len, pieces(text.as_buffer().to_pybytes()))) for text in batch.column(0) if text.is_valid]
        yield pa.record_batch({"documents": [sum(x > 0 for x in n)], "length": [sum(n)]})


class Shard:
    """Documents of a shard to be, and their terms."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.names: dict[bytes, int] = {}
        self.term, self.times, self.size, self.length = [], [], 0, []

    def add(self, doc: int | None, found: Counter) -> None:
        names = self.names
        self.term.append(np.fromiter((names.setdefault(t, len(names)) for t in found), dtype=np.int32, count=len(found)))
        self.times.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        self.docs.append(doc)
        self.length.append(sum(found.values()))
        self.size += len(found)

    def row(self, number: int, documents: int, length: int) -> pa.RecordBatch:
        names = sorted(self.names)
        place = np.empty(len(names), dtype=np.int32)
        place[[self.names[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term, times = place[np.concatenate(self.term)], np.concatenate(self.times)
        at = np.repeat(np.arange(len(self.docs)), [len(t) for t in self.term])
        lowered = np.array([100 - LENGTH + LENGTH * n * documents // length for n in self.length], dtype=np.int64)
        impact = SCALE * times // (OFTEN * times + LONG * lowered[at])
        order = np.argsort(term, kind="stable")
        term, at, impact = term[order], at[order], impact[order]
        levels, own, nodes, most = [], term, at, impact
        for low, high in zip((1, *RANGES), RANGES):
            key = own.astype(np.int64) * SHARD + nodes // (high // low)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            own, nodes, most = own[first], (key[first] % SHARD), np.maximum.reduceat(most, first)
            levels.append({"df": np.bincount(own, minlength=len(names)).astype(np.int32), "node": nodes.astype(np.int16), "most": most.astype(np.int32)})
        levels.pop()  # each term has one range as large as the shard: `tops`
        rows = {"shard": number, "docs": self.docs, "terms": names, "df": np.bincount(term, minlength=len(names)).astype(np.int32), "at": at.astype(np.int16), "impact": impact.astype(np.int32), "levels": levels, "tops": most.astype(np.int32)}
        return pa.RecordBatch.from_pylist([rows], schema=ARROW)


_INTS = pa.list_(pa.int32())
ARROW = pa.schema([
    ("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("df", _INTS), ("at", pa.list_(pa.int16())), ("impact", _INTS),
    ("levels", pa.list_(pa.struct([("df", _INTS), ("node", pa.list_(pa.int16())), ("most", _INTS)]))), ("tops", _INTS),
])


@dataclass
class Index:
    """The shards, how many documents have a term, and how many terms they have together."""

    shards: DataFrame
    documents: int
    length: int


def index(docs: DataFrame, folder: str | None = None) -> Index:
    """The index of all rows of `docs` (doc_id, text), written to `folder` or else kept in the shared one as long as it is referred to."""
    sums = docs.select(F.col("text").cast("string")).mapInArrow(sizes, "documents bigint, length bigint")
    documents, length = sums.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = counted(text.as_buffer().to_pybytes()) if text.is_valid else None
                if not found:
                    continue
                if open_.docs and (len(open_.docs) == SHARD or open_.size + len(found) > POSTINGS):
                    yield open_.row(number, documents, length)
                    number, open_ = number + 1, Shard()
                open_.add(doc.as_py(), found)
        if open_.docs:
            yield open_.row(number, documents, length)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shards, INDEX)
    if folder is None:
        return Index(cut(rows), documents, length)
    rows.write.parquet(folder)
    return Index(docs.sparkSession.read.parquet(folder), documents, length)


def vectors(found: Index, items: DataFrame) -> DataFrame:
    """(item, term, weight): the terms of each item, whose weight is that of the term times its occurrences in the item."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = items.select("item", F.explode(terms).alias("term")).groupBy("item", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    known = found.shards.select(F.inline(F.arrays_zip("terms", "df"))).withColumnRenamed("terms", "term")
    # only terms that are asked for are summed
    df = known.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * found.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return asked.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight"))


class Asked:
    """A block of items: their terms by number and what each counts for, one item after the other."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        names = rows["term"].to_pylist()
        self.terms = {t: k for k, t in enumerate(sorted(set(names)))}
        item, term, weight = rows["item"].to_numpy(), np.array([self.terms[t] for t in names], dtype=np.int32), rows["weight"].to_numpy()
        order = np.lexsort((term, item))
        self.term, self.weight = term[order], weight[order]
        self.items, self.starts = np.unique(item[order], return_index=True)
        self.number = {i: k for k, i in enumerate(self.items.tolist())}
        self.floor = np.ones(len(self.items), dtype=np.int64)  # a hit must score at least this

    def tops(self, terms: list[bytes], tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items' bounds in a shard, and where there each of their terms is, -1 if nowhere."""
        place = np.full(len(self.terms), -1, dtype=np.int32)
        for k, t in enumerate(terms):
            if (n := self.terms.get(t)) is not None:
                place[n] = k
        most = np.where(place >= 0, tops[place].astype(np.int64), 0)
        return np.add.reduceat(self.weight * most[self.term], self.starts), place


class Ranges:
    """A shard's postings and maxima of some of its terms, laid out by range."""

    def __init__(self, row: dict, chosen: np.ndarray):
        own = np.full(len(row["df"]), -1, dtype=np.int64)
        own[chosen] = np.arange(len(chosen))
        term = np.repeat(own, row["df"])
        self.at, self.impact, term = row["at"][term >= 0].astype(np.int64), row["impact"][term >= 0].astype(np.int64), term[term >= 0]
        blocks = SHARD // RANGES[0]
        self.bounds = np.searchsorted(term * blocks + self.at // RANGES[0], np.arange(len(chosen) * blocks + 1)).astype(np.int32)
        self.most = []
        for size, level in zip(RANGES, row["levels"]):
            who = np.repeat(own, level["df"])
            most = np.zeros((len(chosen), SHARD // size), dtype=np.int32)
            most[who[who >= 0], level["node"][who >= 0]] = level["most"][who >= 0]
            self.most.append(most)

    def scores(self, block: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of all documents in a range of the lowest level."""
        low = terms * (SHARD // RANGES[0]) + block
        start, n = self.bounds[low], self.bounds[low + 1] - self.bounds[low]
        places = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        out = np.zeros(RANGES[0], dtype=np.int64)
        np.add.at(out, self.at[places] - block * RANGES[0], self.impact[places] * np.repeat(weights, n))
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, floor: int, docs: list[int | None], top: int) -> list[tuple[int, int]]:
        """(score, document's number) of the `top` documents that score `floor` or more: ranges in the order of their bounds."""
        found: list[tuple[int, bool, int, int]] = []  # best first
        level = len(self.most) - 1
        width = RANGES[level + 1] // RANGES[level]
        queue = [(-b, level, k) for k, b in enumerate((weights @ self.most[level][terms]).tolist()) if b >= floor]
        heapq.heapify(queue)
        while queue and -queue[0][0] >= floor:
            _, level, node = heapq.heappop(queue)
            if level:
                width = RANGES[level] // RANGES[level - 1]
                below = weights @ self.most[level - 1][terms, node * width : (node + 1) * width]
                for k in np.flatnonzero(below >= floor).tolist():
                    heapq.heappush(queue, (-int(below[k]), level - 1, node * width + k))
                continue
            scores = self.scores(node, terms, weights)
            for k in np.flatnonzero(scores >= floor).tolist():
                doc = node * RANGES[0] + k
                found.append((-int(scores[k]), docs[doc] is None, docs[doc] or 0, doc))
            if len(found) > top:
                found = heapq.nsmallest(top, found)
            if len(found) == top:
                floor = max(floor, -max(found)[0])
        return [(-s, doc) for s, _, _, doc in found]


def numbers(values: pa.Scalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False)


def unpacked(batch: pa.RecordBatch, i: int) -> dict:
    """A shard's row with its lists as arrays."""
    row = {c: numbers(batch[c][i]) for c in ("df", "at", "impact")}
    levels = batch["levels"][i].values
    return row | {"levels": [{c: numbers(levels[k][c]) for c in ("df", "node", "most")} for k in range(len(levels))]}


BOUNDS = pa.schema([("item", pa.int64()), ("bound", pa.int64()), ("shard", pa.int64())])
HITS = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])


def search_block(shards: DataFrame, asked: Asked, top: int) -> DataFrame:
    """(item, score, doc_id): of each item of the block its best hits, `top` of each shard at most and all of the best ones."""
    context = shards.sparkSession.sparkContext
    plain = context.broadcast(asked)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bound, _ = plain.value.tops(batch["terms"][i].as_py(), numbers(batch["tops"][i]))
                some = bound > 0
                yield pa.record_batch([plain.value.items[some], bound[some], np.full(some.sum(), batch["shard"][i].as_py())], schema=BOUNDS)

    best = shards.select("shard", "terms", "tops").mapInArrow(bounds, "item bigint, bound bigint, shard bigint")
    best = best.groupBy("item").agg(F.max(F.struct("bound", "shard")).alias("best")).groupBy("best.shard").agg(F.collect_list("item").alias("asked"))

    def hits(batches: Iterator[pa.RecordBatch], block: Asked) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bound, place = block.tops(batch["terms"][i].as_py(), numbers(batch["tops"][i]))
                some = np.flatnonzero((bound >= block.floor) & (bound > 0))
                if "asked" in batch.schema.names:  # each item is asked for in one shard
                    some = np.intersect1d(some, [block.number[x] for x in batch["asked"][i].as_py()])
                if not len(some):
                    continue
                chosen = np.unique(place[place >= 0])
                own = np.full(len(place), -1, dtype=np.int64)
                own[place >= 0] = np.searchsorted(chosen, place[place >= 0])
                ranges, docs, out = Ranges(unpacked(batch, i), chosen), batch["docs"][i].as_py(), []
                ends = np.r_[block.starts[1:], len(block.term)]
                for k in some.tolist():
                    terms, weights = own[block.term[block.starts[k] : ends[k]]], block.weight[block.starts[k] : ends[k]]
                    out += [(int(block.items[k]), score, docs[doc]) for score, doc in ranges.best(terms[terms >= 0], weights[terms >= 0], int(block.floor[k]), docs, top)]
                yield pa.RecordBatch.from_pylist([dict(zip(HITS.names, row)) for row in out], schema=HITS)

    fields = "item bigint, score bigint, doc_id bigint"
    first = shards.join(F.broadcast(best), "shard").mapInArrow(lambda batches: hits(batches, plain.value), fields)
    # as many numbers as the block has items: the k-th score of those with so many hits
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = first.withColumn("rank", rank).where(F.col("rank") == top).select("item", "score").toArrow()
    for item, score in zip(least["item"].to_pylist(), least["score"].to_pylist()):
        asked.floor[asked.number[item]] = max(1, score)
    bounded = context.broadcast(asked)
    return shards.mapInArrow(lambda batches: hits(batches, bounded.value), fields)


def search(found: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `items` (item_id, text) the `top` best documents, equal scores by id."""
    spark = items.sparkSession
    items = cut(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    asked = cut(vectors(found, items))
    blocks = -(-asked.count() // ENTRIES)
    all_: DataFrame | None = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if rows.num_rows:
            hits = search_block(found.shards, Asked(rows), top)
            all_ = hits if all_ is None else all_.union(hits)
    if all_ is None:
        all_ = spark.createDataFrame([], "item bigint, score bigint, doc_id bigint")
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = all_.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
RANKED_SQL = f"""
with d as (select row_number() over () as row, doc_id, {_TERMS} as ts from documents),
s as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select row, doc_id, len, t, count(*) as tf from (select row, doc_id, len(ts) as len, unnest(ts) as t from d) group by all),
df as (select t, floor(1000 * ln((2.0::double * (select n from s) + 2) / (2.0::double * count(*) + 1)))::bigint as w from p group by 1),
i as (select item, item_id, t, count(*) as times from (select row_number() over () as item, item_id, unnest({_TERMS}) as t from benchmark) group by all),
h as (select item, item_id, row, doc_id, sum(times * w * (({SCALE} * tf) // ({OFTEN} * tf + {LONG} * ({100 - LENGTH} + ({LENGTH} * len * s.n) // s.l))))::bigint as score
      from i join df using (t) join p using (t), s group by all),
r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last, row) as rank from h where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= {TOP}
"""
