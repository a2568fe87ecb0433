"""A stored index of vectors: coarse cells around centroids, with the bound of each cell for exact answers.

build() fits centroids to a bounded sample and deals every vector to its nearest one. A row of the index is a part of a cell, at most
about PACK vectors in one flat array, so that a cell with a third of all vectors is many rows. There are about sqrt(n) cells, so that a search
that probes a fixed number of them reads about sqrt(n) vectors; how many it takes for the wanted recall is measured on the sample.

search() sends each query to the cells nearest to it, joins queries and parts by cell, and multiplies them block by block. In exact mode
the k-th distance found is the radius of a second probe: by the triangle inequality on the sphere a cell whose bound (the query's angle to
its centroid less the cell's reach) is beyond that radius holds nothing nearer; all other cells are read too.

Cases: vectors that are null, zero, hold null or non-finite components or have another length than most are in no answer; a query
of that kind has none; vectors of one id are found each; an empty table has an index without cells, and no answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: Most cells; vectors of a cell's part; queries of a block; bytes of the sample on the driver; rounds of fitting.
CELLS, PACK, BLOCK, SAMPLE_BYTES, ROUNDS = 4096, 4096, 1024, 64 << 20, 12
#: Share of the nearest neighbours that the number of probes is chosen for, how many neighbours, and vectors of the sample that choose it.
RECALL, NEAREST, JUDGES = 0.95, 10, 256
#: Bytes of a matrix of products in a task, and of a batch that it gives out.
MATRIX_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
#: What rounding may change an angle by.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """The parts of all cells, (cell, part, ids, values); the cells' centroids, reaches (in radians) and sizes; how many are probed."""

    parts: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    probes: int


def valid(vector: Column, size: int) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fitted(sample: np.ndarray, cells: int, seed: int = 17) -> np.ndarray:
    """Centroids of unit length: each the direction of the mean of the sample's vectors nearest to it."""
    pick = np.random.default_rng(seed).permutation(len(sample))[:cells]
    centroids = sample[pick]
    for _ in range(ROUNDS):
        own = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centroids)
    return centroids


def slices(n: int, width: int) -> list[slice]:
    """`n` rows in pieces whose products with `width` others are MATRIX_BYTES at most."""
    step = max(1, MATRIX_BYTES // (8 * max(1, width)))
    return [slice(k, k + step) for k in range(0, n, step)]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[s] @ centroids.T).argmax(1) for s in slices(len(rows), len(centroids))]) if len(rows) else np.zeros(0, dtype=np.int64)


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The least number of probed cells that finds this share of the sample's own nearest neighbours."""
    asked = sample[: min(JUDGES, len(sample))]
    most = min(NEAREST, len(sample) - 1)
    if most < 1:
        return len(centroids)
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    found = np.argpartition(-near, most - 1, axis=1)[:, :most]
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, centroids)[found], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build(vectors: DataFrame, folder: str | None = None, recall: float = RECALL) -> VectorIndex:
    """The index of `vectors` (vec_id, embedding), its parts written to `folder` or else kept in the shared one as long as they are referred to."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    row = lengths.orderBy(F.desc("n"), "size").first()
    size = row["size"] if row else 1
    good = vectors.where(valid(F.col("embedding"), size))
    n = good.count()
    cells = max(1, min(CELLS, round(n**0.5)))
    room = max(cells, SAMPLE_BYTES // (8 * size))
    some = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // room)))) == 0).select("embedding").limit(2 * room).toArrow()
    sample = unit(some["embedding"].combine_chunks().values.to_numpy().reshape(-1, size)) if some.num_rows else np.zeros((0, size))
    centroids = fitted(sample, cells)
    shared = spark.sparkContext.broadcast(centroids)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = unit(np.stack(batch.embedding))
                own = nearest(rows, shared.value)
                yield batch.assign(cell=own, close=np.einsum("ij,ij->i", rows, shared.value[own]))

    found = cut(good.mapInPandas(dealt, "vec_id bigint, embedding array<double>, cell int, close double")) if len(centroids) else spark.createDataFrame([], "vec_id bigint, embedding array<double>, cell int, close double")
    sizes = found.groupBy("cell").agg(F.count("*").alias("n"), F.min("close").alias("close"))
    reach, count = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in sizes.collect():  # a row for each cell
        reach[r.cell], count[r.cell] = np.arccos(np.clip(r.close, -1, 1)), r.n
    split = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / PACK).alias("parts")))
    rows = found.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int"))
    packed = rows.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    packed = packed.select("cell", "part", F.col("rows.vec_id").alias("ids"), F.flatten("rows.embedding").alias("values"))
    if folder is None:
        parts = cut(packed)
    else:  # in the order of cells, so that a reader that asks for some of them skips the others' row groups
        packed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(folder)
        parts = spark.read.parquet(folder)
    return VectorIndex(parts, centroids, reach, count, probes_for(sample, centroids, recall) if len(centroids) else 0)


def probed(index: VectorIndex, queries: DataFrame, exact: bool) -> DataFrame:
    """(query_id, cell, embedding): the cells nearest to each query, or, exact, all others that may hold something as near as `worst`."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.reach, index.sizes, index.probes))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, reach, sizes, probes = shared.value
        given = max(1, BATCH_BYTES // (8 * centroids.shape[1]))  # a query goes out with its vector for each cell
        for batch in (whole.iloc[s] for whole in batches for s in slices(len(whole), len(centroids))):
            close = unit(np.stack(batch.embedding)) @ centroids.T
            order = np.argsort(-close, axis=1, kind="stable")
            asked = np.zeros(close.shape, dtype=bool)
            np.put_along_axis(asked, order[:, :probes], True, axis=1)
            if exact:
                radius = np.arccos(np.clip(1 - batch.worst.to_numpy(dtype=np.float64), -1, 1))[:, None]
                asked = ~asked & (np.arccos(np.clip(close, -1, 1)) - reach[None, :] <= radius + SLACK)
            row, cell = np.nonzero(asked & (sizes > 0)[None, :])
            for k in range(0, len(row), given):
                at = row[k : k + given]
                yield pd.DataFrame({"query_id": batch.query_id.to_numpy()[at], "cell": cell[k : k + given].astype(np.int32), "embedding": batch.embedding.to_numpy()[at]})

    return queries.mapInPandas(choose, "query_id bigint, cell int, embedding array<double>")


def answered(index: VectorIndex, asked: DataFrame, most: int, blocks: int, itself: bool) -> DataFrame:
    """(query_id, vec_id, distance): of each part of a probed cell the `most` nearest vectors."""
    groups = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    size = index.centroids.shape[1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values.to_numpy(zero_copy_only=False)
                rows = unit(batch["values"][i].values.to_numpy(zero_copy_only=False).reshape(-1, size))
                queries = batch["asked"][i].values
                names = queries.field("query_id").to_numpy(zero_copy_only=False)
                vectors = unit(queries.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                for s in slices(len(names), len(ids)):
                    distance = np.round(1 - vectors[s] @ rows.T, 9) + 0.0
                    for k, name in enumerate(names[s]):
                        at = np.arange(len(ids)) if itself else np.flatnonzero(ids != name)
                        near = distance[k, at]
                        if len(at) > most:  # all that tie with the last one stay until ids decide
                            at = at[near <= np.partition(near, most - 1)[most - 1]]
                        at = at[np.lexsort((ids[at], distance[k, at]))[:most]]
                        yield pa.record_batch({"query_id": np.full(len(at), name), "vec_id": ids[at], "distance": distance[k, at]})

    return index.parts.join(groups, "cell").select("ids", "values", "asked").mapInArrow(compare, "query_id bigint, vec_id bigint, distance double")


def search(index: VectorIndex, queries: DataFrame, most: int, exact: bool = False, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank): the `most` nearest vectors of each row of `queries` (query_id, embedding) by the index.

    A vector of the query's own id is left out unless `itself`. Ids of queries are unique. Exact answers are those of a comparison with all vectors.
    """
    size = index.centroids.shape[1]
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid(F.col("embedding"), size))
    blocks = max(1, -(-queries.count() // BLOCK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    first = answered(index, probed(index, queries, False), most, blocks, itself)
    if exact:
        first = cut(first.withColumn("rank", rank).where(F.col("rank") <= most))
        worst = first.where(F.col("rank") == most).select("query_id", F.col("distance").alias("worst"))
        bounded = queries.join(worst, "query_id", "left").na.fill(2.0, ["worst"])  # with too few answers every cell is asked
        first = first.drop("rank").union(answered(index, probed(index, bounded, True), most, blocks, itself))
    return first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def rows_read(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, read): how many vectors the probed cells of each query hold."""
    sizes = index.parts.sparkSession.createDataFrame([(int(k), int(n)) for k, n in enumerate(index.sizes)], "cell int, n bigint")
    good = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(valid(F.col("embedding"), index.centroids.shape[1]))
    return probed(index, good, False).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("read"))
