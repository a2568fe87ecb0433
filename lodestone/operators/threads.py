"""Posts of different networks that belong together: close in time and in meaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Posts of a block; what another order of adding may change a cosine by; pairs of a batch.
BLOCK, SLACK, PAIRS = 512, 1e-9, 65_536


def across_networks(posts: DataFrame, within_s: int, most_distance: float) -> DataFrame:
    """(a, b, distance) of posts (id, source, at, embedding) of two networks, at most `within_s` seconds and `most_distance` apart, a before b.

    A range join by spans of time: a pair lies in one span or in neighbouring ones, so posts go to their span and the next, and a
    pair is taken where the later post is in its own span. The posts of a span are blocks of about BLOCK by a digest of their ids, so that
    a span with most posts is many rows; pairs of blocks are multiplied as matrices, and each pair that is near enough is added up as
    cosine_distance() does it. The number of pairs within a time grows with the square of the posts: that is the job.

    Cases: vectors that are null, zero, hold null or non-finite components or differ in length are near nothing.
    """
    types = {f.name: f.dataType.simpleString() for f in posts.schema}
    rows = posts.where("at is not null and source is not null and id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    rows = rows.select("id", "source", "at", F.col("embedding").cast("array<double>").alias("v"), F.floor(F.col("at") / within_s).alias("span"), F.size("embedding").alias("size"))
    sizes = rows.groupBy("span", "size").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    rows = rows.join(sizes, ["span", "size"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = rows.groupBy("span", "size", "part").agg(F.collect_list(F.struct("id", "source", "at", "v")).alias("l"))
    blocks = blocks.select("span", "size", "part", *[F.col(f"l.{c}").alias(c) for c in ("id", "source", "at")], F.flatten("l.v").alias("v"))
    early = blocks.select(F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("span"), "size", *[F.col(c).alias(f"{c}_a") for c in ("id", "source", "at", "v")])
    late = blocks.select("span", "size", *[F.col(c).alias(f"{c}_b") for c in ("id", "source", "at", "v")])
    both = early.join(late, ["span", "size"]).drop("span")
    plain = lambda batch, name, i: batch[name][i].values.to_numpy(zero_copy_only=False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = batch["size"][k].as_py()
                a, b = ({c: plain(batch, f"{c}_{side}", k) for c in ("id", "source", "at", "v")} for side in "ab")
                va, vb = a["v"].reshape(-1, size), b["v"].reshape(-1, size)
                with np.errstate(all="ignore"):
                    bound = np.sqrt((va * va).sum(1))[:, None] * np.sqrt((vb * vb).sum(1))[None, :]
                    i, j = np.nonzero(va @ vb.T >= (1 - most_distance - SLACK) * bound)
                gap = b["at"][j] - a["at"][i]
                ok = (a["source"][i] != b["source"][j]) & (gap <= within_s) & ((gap > 0) | ((gap == 0) & (a["id"][i] < b["id"][j])))
                i, j = i[ok], j[ok]
                for low in range(0, len(i), PAIRS):
                    x, y = i[low : low + PAIRS], j[low : low + PAIRS]
                    with np.errstate(all="ignore"):
                        total = norm_a = norm_b = np.zeros(len(x))
                        for d in range(size):  # in the order of components, as sums by Spark are
                            p, q = va[x, d], vb[y, d]
                            total, norm_a, norm_b = total + p * q, norm_a + p * p, norm_b + q * q
                        distance = 1 - total / (np.sqrt(norm_a) * np.sqrt(norm_b))
                    yield pa.record_batch({"a": a["id"][x], "b": b["id"][y], "distance": distance})

    found = both.mapInArrow(compare, f"a {types['id']}, b {types['id']}, distance double")
    return found.select("a", "b", (F.round("distance", 9) + 0.0).alias("distance")).where((F.col("distance") <= most_distance) & ~F.isnan("distance"))
