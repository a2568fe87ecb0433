"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles. Sets are embedded to minhash tokens; from the root, every run sends a set down the
paths of sampled token positions, so that sets which share the token meet. Large buckets are split again on further sampled
positions, small ones are compared by brute force on byte sketches, and there are as many runs as the target recall needs.
Sketches that are alike join a loose group. Within each loose group the sets themselves are compared exactly, in
blocks bounded by shingles and by sets, and give link counts and classes without a row per pair.

Equal sets are one set with a number of copies. Words are compared as they stand.

Cases: null and empty texts have no shingle and link with nothing; a text under `n` words is one shingle; rows that repeat a doc_id get
a row each; rows without a doc_id get no class and no links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cells import Sets, edges_of, in_cells, linked, whole_keys
from lodestone.llm.common import apart, components, cut, dealt, maybe_in, table
from lodestone.llm.wordhash import U, mix, shingles

N, SIMILAR = 5, 0.8
#: Minhash tokens of a set; similarity of sketches from which sets join a loose group (four deviations below SIMILAR).
TOKENS, LOOSE = 64, 0.6
#: Sets that are compared by brute force at once; levels of splitting before larger buckets are compared in blocks.
SMALL, LEVELS, RECALL = 2000, 3, 0.999
#: Shingles and sets of a block of a loose group on average at most.
BLOCK, ROWS = 300_000, 500
SALTS = mix(np.arange(1, TOKENS + 1, dtype=U)) | U(1)
PROFILE = "doc_id bigint, k1 bigint, k2 bigint, n int, tokens binary, sketch binary"


def runs_needed(similar: float = SIMILAR, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Positions at the root so that a pair at the threshold meets at the end of some path, even if all `levels` splits are needed."""
    lost = 0.0
    for _ in range(levels):
        lost = (1 - similar / (similar * TOKENS) * (1 - lost)) ** TOKENS
    return min(TOKENS, math.ceil(math.log(1 - recall) / math.log(1 - similar * (1 - lost))))


def key_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    return int(found.sum(dtype=U).astype(np.int64)), int(np.bitwise_xor.reduce(mix(found + U(7))).astype(np.int64)) if len(found) else 0


def tokens_of(found: np.ndarray) -> np.ndarray:
    """The set's minhash tokens, 32 bits each."""
    least = np.full(TOKENS, 0xFFFFFFFF, dtype=U)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((mix(found[at : at + 4096])[None, :] * SALTS[:, None]) >> U(32)).min(1))
    return least.astype(np.uint32)


def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.doc_id, batch.text):
            found = shingles(text, N)
            tokens = tokens_of(found)
            rows.append((doc_id, *key_of(found), len(found), tokens.tobytes(), mix(tokens.astype(U)).astype(np.uint8).tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "k1", "k2", "n", "tokens", "sketch"])


def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Brute force on buckets (node, doc, n, sketch), sorted by node: links to the smallest document of each loose set.

    Members at distance 1, 2, ... are compared all at once; those that are joined already needn't be.
    """
    for rows in whole_keys(batches, "node"):
        node, n, doc = rows.node.to_numpy(), rows.n.to_numpy(), rows.doc.to_numpy()
        sketch = np.frombuffer(b"".join(rows.sketch), dtype=np.uint8).reshape(-1, TOKENS)
        sets = Sets(len(rows))
        left = np.arange(len(rows))
        for step in range(1, len(rows)):
            left = left[left + step < len(rows)]
            left = left[node[left] == node[left + step]]
            if not len(left):
                break
            name = sets.names()
            a = left[name[left] != name[left + step]]
            b = a + step
            close = np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b])
            a, b = a[close], b[close]
            for at in range(0, len(a), 65536):
                x, y = a[at : at + 65536], b[at : at + 65536]
                hit = (sketch[x] == sketch[y]).sum(1, dtype=np.int32) >= LOOSE * TOKENS
                sets.join(x[hit], y[hit])
        name = sets.names()
        keep = name != np.arange(len(rows))
        yield pd.DataFrame({"a": doc[keep], "b": doc[name[keep]]}).drop_duplicates()


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): links of loose groups between the sets (doc, n, tokens, sketch)."""
    token = lambda i: F.substring(F.col("tokens"), 4 * i + 1, 4)
    order = np.random.default_rng(5).permutation(TOKENS)[: runs_needed()].tolist()
    paths = F.array(*[F.xxhash64(F.lit(i), token(i)) for i in order])
    rows = sets.select("doc", F.explode(paths).alias("node"))
    found = []
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select(apart("node"), "size")
        rows = cut(rows.join(sizes, "node"))
        found.append(rows.where(F.col("size") <= SMALL).select("node", "doc"))
        rows = rows.where(F.col("size") > SMALL)
        if rows.isEmpty():
            break
        if level == LEVELS:  # copies that no split tells apart: blocks of the bucket meet pairwise
            chunks = F.ceil(F.col("size") * 2 / SMALL).cast("int")
            cell = F.explode(in_cells(F.pmod(F.xxhash64("doc"), chunks).cast("int"), chunks))
            found.append(rows.select("node", "doc", cell.alias("cell")).select(F.xxhash64("node", "cell").alias("node"), "doc"))
            break
        # each position is chosen with probability 1 / (similarity * tokens), by a digest that all of the bucket share
        spans = [F.when(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) < int((1 << 20) / (SIMILAR * TOKENS)), F.xxhash64("node", F.lit(i), token(i))) for i in range(TOKENS)]
        rows = rows.join(sets.select("doc", "tokens"), "doc").select("doc", F.explode(F.array_compact(F.array(*spans))).alias("node"))
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.union(more)
    buckets = buckets.join(sets.select("doc", "n", "sketch"), "doc")
    return dealt(buckets, "node", "doc").mapInPandas(alike, "a bigint, b bigint")


def common_counts(found: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by products of incidence blocks."""
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    _, column, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(found), len(found)), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(found), 4096), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return total


def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells (cell, doc, chunk, i, j, copies, k1, k2, text), sorted by cell: each document's links in the cell and the smallest document it reaches there."""
    for rows in whole_keys(batches, "cell"):
        edge = edges_of(rows.cell.to_numpy())
        for start, stop in zip(edge, edge[1:]):
            if stop - start < 2:
                continue
            part = rows.iloc[start:stop]
            found = [shingles(t, N) for t in part.text]
            own = np.array([key_of(f) == k for f, k in zip(found, zip(part.k1, part.k2))])  # not another row of the same id
            found = [f for f, o in zip(found, own) if o]
            part = part[own]
            size = np.array([len(f) for f in found], dtype=np.float64)
            both = common_counts(found)
            link = both >= SIMILAR * (size[:, None] + size[None, :] - both) - 1e-9
            if part.i.iat[0] != part.j.iat[0]:  # pairs of one chunk are met in its own cell
                link &= part.chunk.to_numpy()[:, None] != part.chunk.to_numpy()[None, :]
            np.fill_diagonal(link, False)
            doc = part.doc.to_numpy()
            some = link.any(1)
            yield pd.DataFrame({"doc": doc[some], "links": (link @ part.copies.to_numpy().astype(np.float64))[some].astype(np.int64), "least": doc[linked(link)][some]})


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): the smallest doc_id of a document's class and its number of links, a row per row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(docs.where("doc_id is not null").mapInPandas(profiles, PROFILE))
    classes = found.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    classes = cut(classes)
    sets = cut(found.join(classes.select(F.col("doc").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("doc"), "n", "tokens", "sketch"))
    groups = components(candidates(sets)).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    groups = cut(groups.join(classes, "doc"))
    weight = groups.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / ROWS)).cast("int").alias("chunks"))
    weight = weight.select(apart("group"), "chunks")
    placed = groups.join(weight, "group").drop("n").withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    texts = docs.withColumnRenamed("doc_id", "doc").where("doc is not null").where(maybe_in(groups, "doc")).join(placed, "doc")
    cells = texts.select("*", F.explode(in_cells(F.col("chunk"), F.col("chunks"))).alias("at"))
    cells = cells.select(F.xxhash64("group", "at.i", "at.j").alias("cell"), "doc", "chunk", "at.i", "at.j", "copies", "k1", "k2", "text")
    links = cut(dealt(cells, "cell", "doc").mapInPandas(exact, "doc bigint, links bigint, least bigint"))
    names = components(links, "doc", "least").withColumnRenamed("node", "doc")
    counts = links.groupBy("doc").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, "doc", "left").join(names, "doc", "left")
    classes = classes.select("k1", "k2", "n", F.coalesce("component", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = found.select("doc_id", "k1", "k2", "n").join(classes, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays."""
    gone = cut(join(docs).where("class_id <> doc_id").select("doc_id").distinct())
    named, maybe = docs.where("doc_id is not null"), maybe_in(gone, "doc_id")
    rest = named.where(maybe).join(gone, "doc_id", "left_anti").select(docs.columns)
    return docs.where("doc_id is null").union(named.where(~maybe)).union(rest)


JACCARD_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - {N - 2}, 2))) as k from d where len(w) > 0),
x as (select distinct doc_id, hash(array_to_string(w[k:k + {N - 1}], ' ')) as h from p),
n as (select doc_id, count(*) as n from x group by 1),
e as (select a.doc_id as a, b.doc_id as b, count(*) as common from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from e join n na on na.doc_id = a join n nb on nb.doc_id = b where common >= {SIMILAR} * (na.n + nb.n - common) - 1e-9),
reach as (select a as doc_id, b as other from l union select reach.doc_id, l.b from reach join l on l.a = reach.other),
c as (select doc_id, min(other) as least from reach group by 1),
t as (select a as doc_id, count(*) as n_links from l group by 1)
select doc_id, least(doc_id, coalesce(least, doc_id)) as class_id, coalesce(n_links, 0) as n_links from d left join c using (doc_id) left join t using (doc_id)
"""
