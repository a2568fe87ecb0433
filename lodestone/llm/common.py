"""Helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, shared_dir, table

__all__ = ["apart", "bitmap", "bits_at", "components", "cut", "dealt", "maybe_in", "shared_dir", "table"]


def dealt(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """`df` dealt out by key and sorted. All shuffle partitions are used: few bytes can be much work for Python, so they aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, order)


#: Bits of a bitmap for each row it holds, and the least and the most bits, as powers of two: 32 MB at most, whatever the input.
SPARE_BITS, LEAST_BITS, MOST_BITS = 16, 20, 28


def bitmap(rows: DataFrame, key: str) -> tuple[Broadcast, int]:
    """A broadcast bitmap of the last bits of a whole number that is spread evenly, and how many bits they are. Its size follows from the count."""
    bits = min(MOST_BITS, max(LEAST_BITS, (SPARE_BITS * rows.count()).bit_length()))
    words = rows.select(F.pmod(F.col(key), F.lit(1 << bits)).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    held = np.zeros(1 << (bits - 6), dtype=np.int64)
    held[words["w"].to_numpy()] = words["b"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(held), bits


def bits_at(held: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    place = values & ((1 << bits) - 1)
    return (held[place >> 6] >> (place & 63) & 1) == 1


def maybe_in(ids: DataFrame, key: str) -> Column:
    """True for every row whose `key` is among those of `ids`, and for few others as long as these are some ten millions.

    A bitmap of bounded size is gathered and broadcast, so that the exact join that follows needn't shuffle rows without a partner.
    """
    mixed = F.xxhash64(F.col(key).cast("long"))
    shared, bits = bitmap(ids.select(mixed.alias("m")), "m")
    return F.pandas_udf(lambda p: pd.Series(bits_at(shared.value, bits, p.to_numpy())), "boolean")(mixed)


def apart(key: str) -> Column:
    """A whole number as it is, which Spark doesn't know to be the same: rows that are summed by it and then joined on it are
    dealt out twice, and the join, having an exchange of its own, can split a large key."""
    return F.shiftright(F.col(key), 0).alias(key)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of the undirected links, the smallest node it reaches.

    Alternating large-star and small-star rounds on the whole edge table. Each round groups by node with map-side
    minima and joins those minima back, so a node with a third of all edges is split by the skew join. Edges stay in
    the shared folder; the driver only sees a count and a checksum per round. Nodes without a link to another node
    don't appear. Null ends are ignored.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges), None
    while True:
        # large star: every neighbour above a node moves to the smallest of the node's neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(apart("u"), "m")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    least = edges.groupBy("v").agg(F.lit(0).alias("z"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least.select(F.col("v").alias("node"), F.col("v").alias("component")))
