"""Near-duplicate vectors by spherical-cap filters.

Vectors are rotated and split in halves; a filter is a pair of random directions, one of each half's code, and lets a
vector through if the sum of its products with the two exceeds a threshold. A list decoder reads from the sorted products of the
halves all filters that a vector exceeds (a few best ones at least) without looking at the others. Several rotations and codes are
drawn apart, so that a pair is missed only if it shares no filter of any. The number of directions grows with the root of the largest
label's vectors and the threshold with it, so a vector passes as many filters, and a filter as many vectors, at any size.

Vectors of one label and length that share a filter are compared in blocks as bytes, with a bound of what rounding can change: no pair at
the threshold is lost, and those that may link make loose groups. Within each group the vectors themselves are compared exactly,
in blocks, which gives link counts and the smallest vector reached, never pairs.

Equal vectors of a label are one vector with a number of copies.

Cases: null labels, and vectors that are null, empty, zero, or hold null or non-finite components, link with nothing, and vectors
link with those of their length only; rows that repeat a vec_id get a row each, and their vectors count as copies or links
of that id; rows without a vec_id get no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cells import edges_of, in_cells, linked, whole_keys
from lodestone.llm.common import apart, components, cut, dealt, table

SIMILAR = 0.93
#: Directions of a half's code at least; filters a vector passes on average and at least; vectors a filter lets through on average at most.
CODE, PASSED, LEAST, LET_THROUGH, SEED = 64, 24, 24, 500, 3
#: Independent rotations with their codes. One misses about 0.7 % of the lone pairs at the threshold.
CODES = 2
#: Vectors of a block of a bucket or a group.
BLOCK = 500


def code_size(vectors: int) -> int:
    """Directions of a half's code for a label of so many vectors."""
    return max(CODE, math.ceil(math.sqrt(vectors * PASSED / LET_THROUGH)))


class Filters:
    """A product code for vectors of `size` components."""

    def __init__(self, size: int, seed: int = SEED, code: int = CODE):
        r = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(r.normal(size=(size, size)))[0]
        self.half = max(1, size // 2)
        parts = [r.normal(size=(code, n)) for n in (self.half, size - self.half)]
        self.codes = [p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12) for p in parts]
        self.code = code
        self.threshold = NormalDist().inv_cdf(1 - PASSED / code**2) * np.sqrt(2 / size)

    def lists(self, rows: np.ndarray) -> list[np.ndarray]:
        """Every row's filters, sorted; rows have unit length."""
        turned = rows @ self.rotation
        one, two = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        order_one, order_two = np.argsort(-one, axis=1), np.argsort(-two, axis=1)
        out = []
        for a, b, i, j in zip(np.take_along_axis(one, order_one, 1), np.take_along_axis(two, order_two, 1), order_one, order_two):
            # the LEAST best sums are among the LEAST best of each half
            best = np.partition((a[:LEAST, None] + b[None, :LEAST]).ravel(), -LEAST)[-LEAST]
            low = min(self.threshold, best)
            many = np.searchsorted(-b, a - low, side="right")  # b >= low - a
            rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.sort(np.repeat(i, many) * self.code + j[rank]).astype(np.int64))
        return out


def all_lists(codes: list[Filters], rows: np.ndarray) -> list[np.ndarray]:
    """Every row's filters of all codes, sorted: those of the k-th have numbers from k * code * code."""
    parts = [code.lists(rows) for code in codes]
    return [np.concatenate([f + k * codes[0].code ** 2 for k, f in enumerate(of_row)]) for of_row in zip(*parts)]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # neither overflow nor underflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def in_bytes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes and a scale, and how far from the vectors these are."""
    scale = np.abs(rows).max(1) / 127
    held = np.rint(rows / scale[:, None]).astype(np.int8)
    return held, scale, np.linalg.norm(rows - held * scale[:, None], axis=1) + 1e-6


def decoded(code: int):
    """(vec, class, label, size, rough, scale, error, filters) of (vec, class, label, embedding)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[Filters]] = {}
        for batch in batches:
            for size, same in batch.groupby(batch.embedding.map(len)):
                if size not in codes:
                    codes[size] = [Filters(size, SEED + k, code) for k in range(CODES)]
                step = max(1, (1 << 22) // (code + size))
                for at in range(0, len(same), step):
                    part = same.iloc[at : at + step]
                    rows = unit(np.stack([np.asarray(v, dtype=np.float64) for v in part.embedding]))
                    rough, scale, error = in_bytes(rows)
                    yield pd.DataFrame({"vec": part.vec, "class": part["class"], "label": part.label, "size": int(size), "rough": [x.tobytes() for x in rough], "scale": scale, "error": error, "filters": all_lists(codes[size], rows)})

    return run


def apart_cells(part: pd.DataFrame) -> np.ndarray:
    """Which pairs of a cell are compared there: pairs of one chunk are met in that chunk's own cell, and none with itself."""
    chunk = part.chunk.to_numpy()
    pairs = np.ones((len(part), len(part)), dtype=bool) if part.i.iat[0] == part.j.iat[0] else chunk[:, None] != chunk[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in whole_keys(batches, "cell"):
        edge = edges_of(rows.cell.to_numpy())
        for start, stop in zip(edge, edge[1:]):
            if stop - start > 1:
                yield rows.iloc[start:stop]


def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of buckets, sorted by cell: for each vector that may link with another, the smallest one it may reach."""
    for part in cells_of(batches):
        x = np.frombuffer(b"".join(part.rough), dtype=np.int8).reshape(len(part), -1).astype(np.float32) * part.scale.to_numpy(dtype=np.float32)[:, None]
        error = part.error.to_numpy()
        # the product of two vectors differs from that of their stand-ins by e + (1 + e) f at most
        link = (x @ x.T >= SIMILAR - 1e-4 - error[:, None] - error[None, :] - error[:, None] * error[None, :]) & apart_cells(part)
        vec, some = part.vec.to_numpy(), link.any(1)
        if some.any():
            yield pd.DataFrame({"a": vec[some], "b": vec[linked(link)][some]})


def exact(dtype: str):
    """Cells of groups, sorted by cell: each vector's links there and the smallest vector it reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in cells_of(batches):
            same_size = part.v.map(len).to_numpy()
            found = np.zeros((len(part), len(part)), dtype=bool)
            for size in np.unique(same_size):
                at = np.flatnonzero(same_size == size)
                x = unit(np.stack([np.frombuffer(v, dtype=dtype).astype(np.float64) for v in part.v.iloc[at]]))
                found[np.ix_(at, at)] = x @ x.T >= SIMILAR
            label = part.label.to_numpy()
            found &= apart_cells(part) & (label[:, None] == label[None, :])
            vec, some = part.vec.to_numpy(), found.any(1)
            if some.any():
                yield pd.DataFrame({"vec": vec[some], "class": part["class"].to_numpy()[some], "links": (found @ part.copies.to_numpy().astype(np.float64))[some].astype(np.int64), "least": vec[linked(found)][some]})

    return run


def near(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `vectors` (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>" if kind != "float" else "array<float>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    same, name = ["label", "embedding"], ["vec", "class"]
    classes = cut(valid.groupBy(*same).agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")).withColumn("class", F.xxhash64(*same)))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    label = f"label {rows.schema['label'].dataType.simpleString()}"
    listed = classes.select("vec", "class", *same).mapInPandas(decoded(code_size(most)), f"vec bigint, class bigint, {label}, size int, rough binary, scale double, error double, filters array<bigint>")
    listed = cut(listed)
    # which buckets a vector is in, and in which cells of these: rows of a few numbers, to which the vector is joined at the end
    bucket = ["label", "size", "filter"]
    met = listed.select(*name, "label", "size", F.explode("filters").alias("filter")).select(*name, F.xxhash64(*bucket).alias("bucket"))
    full = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(apart("bucket"), "n")
    cells = celled(met.join(full, "bucket"), "bucket", F.ceil(F.col("n") / BLOCK)).join(listed.select(*name, "rough", "scale", "error"), name)
    loose = cut(dealt(cells, "cell", "vec").mapInPandas(alike, "a bigint, b bigint"))
    groups = components(loose).select(F.col("node").alias("vec"), F.col("component").alias("group"))
    groups = cut(groups.join(classes.select(*name), "vec"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).select(apart("group"), "n")
    cells = celled(groups.join(sizes, "group"), "group", F.ceil(F.col("n") / BLOCK)).join(classes, name)
    binary = F.pandas_udf(lambda v: v.map(lambda x: np.asarray(x).tobytes()), "binary")
    cells = cells.select("cell", *name, "chunk", "i", "j", "label", "copies", binary("embedding").alias("v"))
    links = cut(dealt(cells, "cell", "vec").mapInPandas(exact("f4" if kind == "float" else "f8"), "vec bigint, class bigint, links bigint, least bigint"))
    names = components(links, "vec", "least").withColumnRenamed("node", "vec")
    counts = links.groupBy("vec", "class").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, name, "left").join(names, "vec", "left")
    classes = classes.select(*same, F.coalesce("component", "vec").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(classes, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def celled(rows: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(cell, vec, class, chunk, i, j) of rows with their bucket or group: each goes to all cells in which it meets another chunk."""
    rows = rows.withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("vec", "class"), F.col("chunks")).cast("int"))
    rows = rows.select("*", F.explode(in_cells(F.col("chunk"), F.col("chunks"))).alias("at"))
    return rows.select(F.xxhash64(key, "at.i", "at.j").alias("cell"), "vec", "class", "chunk", "at.i", "at.j")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))


VECTORS_SQL = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {SIMILAR}),
reach as (select a as vec_id, b as other from l union select reach.vec_id, l.b from reach join l on l.a = reach.other),
c as (select vec_id, min(other) as least from reach group by 1),
t as (select a as vec_id, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(least, vec_id)) as kept from embeddings left join c using (vec_id) left join t using (vec_id)
"""
