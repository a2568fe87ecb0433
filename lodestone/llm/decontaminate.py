"""Benchmark decontamination by greedy string tiling.

Items and documents are joined on the hashes of `tile` consecutive words, their seeds. A bitmap of the items' seeds, of bounded size,
keeps all other seeds of the documents out of the join. Tiles that cover `cover` of an item's n words hold at least cover * n / tile
places of seeds, so an item can pass over that many of its places less one and still be met: it passes over the seeds that most
documents have. Each candidate pair is then tiled: the longest run of unmarked words that both have is found by running Karp-Rabin
hashes and bisection of its length, and marked on both sides, again and again, until no run of `tile` words is left. A document
is contaminated by an item if the marked words cover at least `cover` of the item; as tiles may lie in any order, reordered
passages count.

Cases: words are compared in lower case; null and empty texts and items share nothing; an item under `tile` words must appear as one
run; null ids are reported as nulls; repeated items and documents are reported each; very long and repetitive texts are tiled in time
that grows with their length times the number of different tile lengths, which is at most the root of twice the item's length;
empty tables give no rows; leaks() ignores further columns and clean() keeps all columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import apart, bits_at, bitmap, cut, maybe_in, table
from lodestone.llm.wordhash import grams, word_hashes

TILE, COVER = 5, 0.5
#: Items that are tiled against one copy of a document.
ITEMS = 500


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "replace"))


def least_places(n: int, tile: int, cover: float) -> int:
    """Places of seeds that tiles over `cover` of n words hold at least: of t words, t - tile + 1 places, which is no less than t / tile."""
    return max(1, math.ceil(cover * n / min(tile, n) - 1e-9))


def shared_part(words: np.ndarray, seeds: np.ndarray, other: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that seeds of the other side cover, and where a new stretch of them starts."""
    hit = np.isin(seeds, other)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.subtract.at(cover, np.flatnonzero(hit) + tile, 1)
    at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    return words[at], np.r_[True, np.diff(at) > 1][: len(at)]


def room(free: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many free words follow from each place on, itself included, before the stretch ends."""
    place = np.arange(len(free))
    barriers = np.r_[np.flatnonzero(starts | ~free), len(free)]
    return np.where(free, barriers[np.searchsorted(barriers, place, side="right")] - place, 0)


class Side:
    """The shared words of an item or a document, with what is still free."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts, self.free = words, starts, np.ones(len(words), dtype=bool)
        self.room = room(self.free, starts)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all free runs of n words, and where they are."""
        at = np.flatnonzero(self.room[: max(0, len(self.words) - n + 1)] >= n)
        return grams(self.words, n)[at], at


def tiled(item: np.ndarray, doc: np.ndarray, tile: int, enough: float = 0.0) -> int:
    """How many words of the item greedy string tiling marks; it may give up once fewer than `enough` can be reached."""
    seeds_i, seeds_d = grams(item, tile), grams(doc, tile)
    a, b = Side(*shared_part(item, seeds_i, seeds_d, tile)), Side(*shared_part(doc, seeds_d, seeds_i, tile))
    marked, top = 0, min(a.room.max(initial=0), b.room.max(initial=0))
    while top >= tile and marked + a.free.sum() >= enough:
        low, high = tile - 1, int(top)  # a run of `low` words is known to be shared, one of more than `high` isn't
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(a.runs(n)[0], b.runs(n)[0]).any() else (low, n - 1)
        if low < tile:
            break
        (hash_a, at_a), (hash_b, at_b) = a.runs(low), b.runs(low)
        places: dict[int, list[int]] = {}
        for h, i in zip(hash_a.tolist(), at_a.tolist()):
            places.setdefault(h, []).append(i)
        queue = {h: iter(p) for h, p in places.items()}  # a place that is taken once is so for good
        hit, end = np.isin(hash_b, hash_a), 0
        for h, j in zip(hash_b[hit].tolist(), at_b[hit].tolist()):
            if j < end:
                continue
            for i in queue[h]:
                if a.free[i : i + low].all() and (a.words[i : i + low] == b.words[j : j + low]).all():
                    a.free[i : i + low] = b.free[j : j + low] = False
                    marked, end = marked + low, j + low
                    break
        a.room, b.room = room(a.free, a.starts), room(b.free, b.starts)
        top = low - 1
    return marked


def seeds_of(items: DataFrame, tile: int, cover: float) -> DataFrame:
    """(item, n, times, spare, seed) of the items (item, text): each seed once, in how many places, and how many places may be passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch.text):
                words = words_of(text)
                if len(words):
                    n = min(tile, len(words))
                    seed, times = np.unique(grams(words, n), return_counts=True)
                    yield pd.DataFrame({"item": item, "n": n, "times": times, "spare": least_places(len(words), tile, cover) - 1, "seed": seed.astype(np.int64)})

    return items.select("item", "text").mapInPandas(run, "item bigint, n int, times bigint, spare bigint, seed bigint")


def key(*columns: str) -> F.Column:
    return F.xxhash64(*columns)


def leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, coverage, key, other): a row per document and item it covers; `key` and `other` name the document with its text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    items = cut(items.withColumn("item", key("item_id", "text")))
    seeds = cut(seeds_of(items, tile, cover))
    sizes = sorted(r.n for r in seeds.select("n").distinct().collect())  # at most `tile` of them
    known, bits = bitmap(seeds.select("seed"), "seed")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, found = [], []
            for name, text in zip(batch.key, batch.text):
                words = words_of(text)
                for n in sizes:
                    got = grams(words, n).astype(np.int64)
                    got = np.unique(got[bits_at(known.value, bits, got)])
                    keys.append(np.full(len(got), name, dtype=np.int64))
                    found.append(got)
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "seed": np.concatenate(found)})

    docs = docs.select("doc_id", "text").where("text is not null").withColumn("key", key("doc_id", "text"))
    got = docs.select("key", "text").mapInPandas(met, "key bigint, seed bigint")
    # a seed may be in most documents: it is dealt out anew for each join and sum, so that the skew join can split it
    got = cut(got.join(seeds.select("seed").distinct().select(apart("seed")), "seed", "left_semi")).select("key", apart("seed"))
    spread = got.groupBy("seed").agg(F.count("*").alias("spread"))
    # of each item the most spread seeds are passed over, as many places as it can spare
    order = Window.partitionBy("item").orderBy(F.desc("spread"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = seeds.join(spread, "seed", "left").na.fill(0, ["spread"]).withColumn("passed", F.sum("times").over(order))
    asked = asked.where("passed > spare and spread > 0").select("item", "seed")
    pairs = cut(got.join(asked, "seed").select("key", "item").distinct())
    groups = pairs.join(items, "item").withColumn("part", F.col("item"))
    many = pairs.groupBy("key").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("parts")).select(apart("key"), "parts")
    groups = groups.join(many, "key").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    groups = groups.groupBy("key", "part").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"), "copies")).alias("items"))

    def cover_of(texts: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([covered(text, found, tile, cover) for text, found in zip(texts, items)])

    some = docs.withColumn("other", F.xxhash64(F.lit("other"), "doc_id", "text")).where(maybe_in(pairs, "key")).join(groups, "key")
    some = some.select("doc_id", "key", "other", F.explode(F.pandas_udf(cover_of, "array<struct<item_id: bigint, coverage: double>>")("text", "items")).alias("leak"))
    return some.select("doc_id", "leak.item_id", "leak.coverage", "key", "other")


def covered(text: str, items, tile: int, cover: float) -> list[dict]:
    doc, out = words_of(text), []
    for item in items:
        words = words_of(item["item_text"])
        share = tiled(words, doc, min(tile, len(words)), cover * len(words)) / len(words)
        if share >= cover:
            out += [{"item_id": item["item_id"], "coverage": share}] * int(item["copies"])
    return out


def clean(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, cover: float = COVER) -> DataFrame:
    """The documents that no item contaminates. Only those whose text may be one of the others' are shuffled."""
    names = [f"__key_{k}" for k in range(2)]
    gone = leaks(docs, benchmark, tile, cover).select(F.col("key").alias(names[0]), F.col("other").alias(names[1]))
    gone = cut(gone.distinct())
    named = docs.withColumn(names[0], key("doc_id", "text")).withColumn(names[1], F.xxhash64(F.lit("other"), "doc_id", "text"))
    maybe = maybe_in(gone, names[0])
    rest = named.where(maybe).join(gone, names, "left_anti")
    return named.where(~maybe).select(docs.columns).union(rest.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per leak: a document and a benchmark item it covers."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))
