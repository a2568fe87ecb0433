"""Mixing sources to target weights by capped water-filling.

Sources share `share` of all sizes by weight. A source's target is clamped at `cap` times its size and the excess goes to
the others by weight, round after round, until none is above its clamp. Each document is then repeated whole
floor(target / size of source) times; the fractional repetition goes to documents in the order of a seeded digest of
their ids, until the source's target is met to within half a document.

mix() gives these decisions; with_repeats() gives the documents themselves with theirs: as decisions follow the digest's order, one mark for
each source, the last document that is taken once more, is all that is joined to them.

Cases: null text counts 0 words; a null source is a source of its own, ordered last; an empty table gives no rows; rows that
repeat a doc_id are documents of their own; null ids take part under an empty digest key; mix() ignores further columns;
with_repeats() keeps them, but for columns of its own names, whose place these take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), "mix"
#: Hex digits of the digest by which a source's documents are summed before the threshold's bucket is looked at closely.
DIGITS, HEAD = 4, 2


def weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """The rows (source, source_size, named) with `weight`: weights repeat over the sources by code point, null last.

    Ranks come from range partitions and the counts of those before, so no task sees all sources.
    """
    parts = cut(sizes.select("source", "source_size", F.col("source").isNull().alias("nameless")).repartitionByRange("nameless", "source").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("nameless", "source")) - 1 + F.col("before")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    return parts.join(before, "part").select("source", "nameless", "source_size", F.get(turns, F.pmod(rank, F.lit(len(weights))).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """`sources` (source_size, weight) with `target`. Each round is one aggregate; the driver keeps the level only."""
    level, limit = 0.0, F.col("source_size") * cap
    while True:
        # sources whose share at this level is above their clamp give their clamp; the rest share what is left
        over = F.col("weight") * level > limit if level else F.lit(False)
        spent, weight = sources.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        risen = (total - spent) / weight
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(F.col("weight") * level, limit))


def runs_out(sums: DataFrame, rests: DataFrame, part: str, where: Column | None = None) -> DataFrame:
    """Of each source's `sums` by `part`, in order from `start` on, the row in which its rest runs out, with what lies `below`."""
    rows = sums.join(rests, "key").where(F.col("named").eqNullSafe(F.col("source")))
    rows = rows if where is None else rows.where(where)
    below = F.col("start") + F.sum("sum").over(Window.partitionBy("key").orderBy(part)) - F.col("sum")
    return rows.withColumn("below", below).where((F.col("below") < F.col("rest")) & (F.col("below") + F.col("sum") >= F.col("rest")))


#: Sources whose marks are broadcast.
MARKS = 20_000
OWN = ("size", "source_size", "target", "repeats", "taken")


def digest(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def decided(docs: DataFrame, share: float, cap: float, weights: tuple[int, ...], seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What mix() and with_repeats() work with: the documents' sizes and places, the sources with their edges, and the documents at the edges."""
    sized = docs.select("doc_id", "source", words().alias("size"))
    sized = cut(sized.withColumn("order", digest(seed)).withColumn("bucket", F.substring("order", 1, DIGITS)))
    # one row per source and bucket: everything below works on these sums
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sizes = buckets.groupBy("source").agg(F.sum("sum").alias("source_size"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    sources = water_fill(cut(weighted(sizes, weights)), share * total, cap)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight", "nameless"))
    key = F.xxhash64(F.col("source").isNull(), "source")
    sources = sources.withColumn("key", key)
    buckets = buckets.withColumn("key", key).withColumn("head", F.substring("bucket", 1, HEAD))
    rests = sources.select("key", "rest", F.col("source").alias("named"), F.lit(0).cast("long").alias("start"))
    # the bucket in which a source's rest runs out: first its head, of 256, then the bucket among those of that head, 256 again
    heads = runs_out(buckets.groupBy("source", "key", "head").agg(F.sum("sum").alias("sum")), rests, "head")
    near = heads.select("key", "rest", "named", F.col("head").alias("at"), F.col("below").alias("start"))
    edge = runs_out(buckets, near, "bucket", (F.col("head") == F.col("at"))).select("key", F.col("bucket").alias("edge"), "below")
    # all buckets before it are taken once more, all after it aren't
    sources = sources.join(edge, "key", "left").withColumn("edge", F.coalesce("edge", F.lit("")))
    docs = sized.withColumn("key", key).alias("d").join(sources.alias("s"), "key").where(F.col("d.source").eqNullSafe(F.col("s.source")))
    docs = docs.select("doc_id", "size", "source_size", "target", "whole", "rest", "order", "key", "bucket", "edge", "below")
    at = Window.partitionBy("key").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("below") + F.sum("size").over(at)
    near = docs.where("bucket = edge").withColumn("more", (upto - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    return docs, sources, near


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken), a row per row of `docs` (doc_id, source, text)."""
    all_, _, near = decided(docs, share, cap, weights, seed)
    far = all_.where("bucket <> edge").withColumn("more", (F.col("bucket") < F.col("edge")).cast("long"))
    repeats = F.col("whole") + F.col("more")
    return near.unionByName(far).select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def with_repeats(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """`docs` and the columns size, source_size, target, repeats and taken: how often the mix takes each document.

    The sources' marks are broadcast if they are at most MARKS with at most 8 MB of names, and else joined by the source. Copies of one id that lie on a mark, some of which are taken and some
    of which aren't, are numbered; only these are dealt out with their texts.
    """
    _, sources, near = decided(docs, share, cap, weights, seed)
    place = F.struct("order", "doc_id", "size")
    last = near.where("more = 1").groupBy("key").agg(F.max(place).alias("last"))
    ties = near.join(last, "key").where(place.eqNullSafe(F.col("last"))).groupBy("key", "last").agg(F.count("*").alias("alike"), F.sum("more").alias("some"))
    marks = cut(sources.join(ties, "key", "left").select(F.struct("source", "source_size", "target", "whole", "edge", "last", "alike", "some").alias("__mark"), F.col("key").alias("__key")))
    own = F.struct(digest(seed).alias("order"), F.col("doc_id").alias("doc_id"), words().alias("size"))
    rows = docs.withColumn("__key", F.xxhash64(F.col("source").isNull(), "source")).withColumn("__own", own)
    count, size = marks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__mark.source")), F.lit(0))).first()
    rows = rows.join(F.broadcast(marks) if count <= MARKS and size <= 8 << 20 else marks, "__key").where(F.col("source").eqNullSafe(F.col("__mark.source")))
    bucket, edge, last = F.substring("__own.order", 1, DIGITS), F.col("__mark.edge"), F.col("__mark.last")
    rows = rows.withColumn("__more", F.when(bucket != edge, bucket < edge).when(last.isNull(), False).when(F.col("__own") != last, F.col("__own") < last).when(F.col("__mark.some") == F.col("__mark.alike"), True))
    number = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))
    open_ = rows.where("__more is null").withColumn("__more", number <= F.col("__mark.some"))
    rows = rows.where("__more is not null").unionByName(open_).withColumn("repeats", F.col("__mark.whole") + F.col("__more").cast("long"))
    return rows.select(*[c for c in docs.columns if c not in OWN], F.col("__own.size").alias("size"), F.col("__mark.source_size").alias("source_size"), F.col("__mark.target").alias("target"), "repeats", (F.col("repeats") * F.col("__own.size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, source_size, target, repeats and taken: the mix holds each of them `repeats` times."""
    return with_repeats(docs)


#: The level is found in closed form here: sources in the order of clamp / weight, the first k at their clamps.
MIX_SQL = f"""
sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                 md5('{SEED}:' || coalesce(doc_id::varchar, '')) as ord from {{docs}}),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
turned as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from sizes),
ranked as (select *, row_number() over (order by 2.0 * source_size / w, source nulls last) as k from turned),
steps as (select *, sum(2.0 * source_size) over (order by k) - 2.0 * source_size as capped,
                 sum(w) over (order by k desc) as open from ranked),
level as (select coalesce(max((1.5 * (select sum(source_size) from sizes) - capped) / open)
                          filter ((1.5 * (select sum(source_size) from sizes) - capped) / open <= 2.0 * source_size / w), 0) as v from steps),
targets as (select source, source_size, least(w * v, 2.0 * source_size)::double as target from turned, level),
runs as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
                sum(d.size) over (partition by d.source order by ord, doc_id, size rows unbounded preceding) as upto
         from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
       ((whole + case when upto - size / 2.0 <= target - whole * source_size and target - whole * source_size > 0 then 1 else 0 end) * size)::bigint as taken
from runs
"""
