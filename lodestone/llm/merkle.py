"""Merkle manifest of a dataset: persisted levels are built bottom-up, and proofs are pushed top-down.

A row's leaf is the digest of its fields, each with its length, so that no two rows of other fields look alike. The leaves of
a group (here: a language) form a tree of `FANOUT` children for each node, and the groups' roots, in the groups' order, form one
tree above them. Each level is a table (grp, pos, n, digest, run): the node's place among the n nodes of its level and the digests
of its children. A level joins children to parents by place div FANOUT. Proofs go the other way: a child prepends its siblings, those left and
those right of it, to what its parent inherited. A leaf and its proof give the root again, without any other row.

At scale: only digests and places are shuffled, texts never. Places come from range partitions over (group, order, leaf) and the
counts of those before, so a group with most rows is many tasks, and a run of children is FANOUT rows whatever the group's size. Levels
are a FANOUT-th of the one below; their number is the logarithm of the largest group.

Cases: a null field is `-`; null text is a leaf like others; rows without the order column come first in their group; rows that repeat it
are ordered by their leaf, and equal leaves have equal proofs but for their places; a null group is a group, the first; an empty
table gives no rows and no root; further columns are neither hashed nor shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

FIELDS, GROUP, ORDER = ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id"
#: Children of a node.
FANOUT = 8
#: Places of groups that are broadcast: a row for each group and range partition. With more they are joined.
PLACES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """The group as a text that is never null and orders as the group does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """`df` written to the manifest's folder and read again, or cut in the shared folder if the manifest has none."""
    if folder is None:
        return cut(df)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with grp) and pos, the place from 0 in the group by `order`, and n, the group's rows.

    A sorted range partition numbers its rows by itself; what comes before it follows from the counts by group and partition.
    """
    near = rows.withColumn("tie", F.monotonically_increasing_id())
    near = cut(near.repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").withColumn("at", F.monotonically_increasing_id()).drop("tie"))
    part = F.shiftright("at", 33).alias("part")
    counts = near.groupBy("grp", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("part")) - F.col("rows")
    counts = cut(counts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("grp")).alias("n")))
    few = counts.limit(PLACES + 1).count() <= PLACES
    return near.withColumn("part", part).join(F.broadcast(counts) if few else counts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def levels(nodes: DataFrame, folder: str | None = None, name: str = "level") -> list[DataFrame]:
    """All levels over `nodes` (grp, pos, n, digest and more), these first; a group's last level holds one node, its root."""
    all_ = [kept(nodes, folder, f"{name}-0")]
    most = all_[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = all_[-1].where("n > 1").select("grp", F.expr(f"pos div {FANOUT}").alias("up"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.struct("pos", "digest").alias("child"))
        runs = below.groupBy("grp", F.col("up").alias("pos"), "n").agg(F.sort_array(F.collect_list("child")).alias("run"))
        runs = runs.withColumn("run", F.col("run.digest"))
        all_.append(kept(runs.withColumn("digest", F.sha2(F.array_join("run", ""), 256)), folder, f"{name}-{len(all_)}"))
        most = -(-most // FANOUT)
    return all_


def roots(tree: list[DataFrame]) -> DataFrame:
    """(grp, digest): each group's root, from whichever level it is in."""
    return reduce(DataFrame.union, [level.where("n = 1").select("grp", "digest") for level in tree])


def push(tree: list[DataFrame], given: DataFrame) -> DataFrame:
    """The lowest level with `proof`, array<struct<left, right>> from there up to what `given` (grp, proof, more) has for the group's root."""
    inherited = [c for c in given.columns if c not in ("grp", "proof")]
    above: DataFrame | None = None
    for level in reversed(tree):
        down = level.where("n = 1").join(given, "grp")
        if above is not None:
            parent = above.select("grp", F.col("pos").alias("up"), F.col("run").alias("beside"), F.col("proof").alias("upward"), *inherited)
            child = level.where("n > 1").withColumn("up", F.expr(f"pos div {FANOUT}")).join(parent, ["grp", "up"])
            at = F.pmod("pos", F.lit(FANOUT)).cast("int")
            own = F.struct(F.array_join(F.slice("beside", F.lit(1), at), "").alias("left"), F.array_join(F.slice("beside", at + 2, F.lit(FANOUT)), "").alias("right"))
            down = down.unionByName(child.withColumn("proof", F.concat(F.array(own), "upward")).drop("up", "beside", "upward"))
        above = down
    return above


@dataclass
class Manifest:
    """The levels of the groups' trees, from the leaves up, and those of the tree over the groups' roots."""

    groups: list[DataFrame]
    top: list[DataFrame]


def build(rows: DataFrame, order: list[str], folder: str | None = None) -> Manifest:
    """The manifest over `rows` (grp, leaf, the columns of `order` and more), ordered within a group by these and the leaf."""
    groups = levels(placed(rows.withColumnRenamed("leaf", "digest"), [*order, "digest"]), folder, "group")
    # the groups themselves are ordered by their keys, as nodes of a group of their own
    over = roots(groups).select(F.lit("").alias("grp"), F.col("grp").alias("below"), "digest")
    return Manifest(groups, levels(placed(over, ["below"]), folder, "top"))


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf's row with subroot, root and proof: its siblings level by level via its group's root up to the root."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = push(manifest.top, roots(manifest.top).select("grp", none.alias("proof"), F.col("digest").alias("root")))
    return push(manifest.groups, over.select(F.col("below").alias("grp"), "proof", F.col("digest").alias("subroot"), "root"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda digest, beside: F.sha2(F.concat(beside["left"], digest, beside["right"]), 256))


def differing(old: Manifest, new: Manifest) -> DataFrame:
    """(grp, pos): the places whose leaves differ or which only one of two manifests has. Only below nodes that differ are levels joined."""
    a, b = (roots(m.groups).withColumnRenamed("digest", name) for m, name in ((old, "a"), (new, "b")))
    other = a.join(b, "grp", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("grp")
    tops, open_ = max(len(old.groups), len(new.groups)), None
    for k in reversed(range(tops)):
        a, b = ((m.groups[k].select("grp", "pos", F.col("digest").alias(name)) if k < len(m.groups) else None) for m, name in ((old, "a"), (new, "b")))
        a = b.select("grp", "pos", F.lit(None).cast("string").alias("a")).limit(0) if a is None else a
        b = a.select("grp", "pos", F.lit(None).cast("string").alias("b")).limit(0) if b is None else b
        # below an open node, and the roots of groups that differ, at whichever level each manifest has them
        at_root = (m.groups[k].where("n = 1").select("grp", "pos") for m in (old, new) if k < len(m.groups))
        ways = reduce(DataFrame.union, at_root).join(other, "grp").distinct()
        if open_ is not None:
            step = open_.select("grp", F.explode(F.sequence(F.col("pos") * FANOUT, F.col("pos") * FANOUT + FANOUT - 1)).alias("pos"))
            ways = ways.union(step).distinct()
        open_ = ways.join(a, ["grp", "pos"], "left").join(b, ["grp", "pos"], "left").where(~F.col("a").eqNullSafe(F.col("b"))).select("grp", "pos")
    return open_


def documents(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): the leaf of each row, and where 3 divides crc32 of the id, that of its text in lower case."""
    text = F.translate("text", UPPER, LOWER)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit, leaf(*[text if c == "text" else F.col(c) for c in FIELDS]))
    return docs.select(group_key(F.col(GROUP)).alias("grp"), F.col(ORDER), leaf(*map(F.col, FIELDS)).alias("leaf"), tampered.alias("tampered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proofs(build(cut(documents(table(spark, sf_dir, "documents"))), [ORDER]))
    beside = F.aggregate("proof", F.lit(""), lambda all_, x: F.concat(all_, x["left"], x["right"]))
    folded_root = folded(F.coalesce("tampered", "digest"), F.col("proof"))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_table() -> list[int]:
    rows = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        rows.append(k)
    return rows


def _level(name: str, k: int, below: str) -> str:
    """SQL for one level up: groups of one node stay as they are; `beside` has a node's siblings to be kept by the one below."""
    return f"""{name}{k} as (select grp, pos // {FANOUT} as pos, ceil(n / {FANOUT}.0)::bigint as n, sha256(string_agg(h, '' order by pos)) as h from {below} where n > 1 group by 1, 2, 3
              union all select grp, pos, n, h from {below} where n = 1)"""


def _fold(name: str, k: int) -> str:
    """SQL for one step of a proof: what stands left and right of the node at level k, and where its parent is."""
    at = f"(partition by grp, pos // {FANOUT} order by pos rows between unbounded preceding and 1 preceding)"
    after = f"(partition by grp, pos // {FANOUT} order by pos rows between 1 following and unbounded following)"
    return f"""{name}_beside{k} as (select grp, pos, n, case when n > 1 then coalesce(string_agg(h, '') over {at}, '') end as l, case when n > 1 then coalesce(string_agg(h, '') over {after}, '') end as r from {name}{k})"""


def _walk(name: str, rows: str, key: str, depth: int) -> list[str]:
    """SQL that takes `rows` (key, grp, pos, fold, beside) up all levels of a tree."""
    steps = []
    for k in range(depth):
        source = rows if k == 0 else f"{name}_walk{k - 1}"
        steps.append(f"""{name}_walk{k} as (select w.* exclude (pos, fold, beside), case when b.n > 1 then w.pos // {FANOUT} else w.pos end as pos,
              case when b.n > 1 then sha256(b.l || w.fold || b.r) else w.fold end as fold, w.beside || coalesce(b.l || b.r, '') as beside
              from {source} w join {name}_beside{k} b on w.grp = b.grp and w.pos = b.pos)""")
    return steps


def _sql(depth: int, top: int) -> str:
    """For at most FANOUT ** depth rows of a language and FANOUT ** top languages."""
    fields = lambda text: " || ".join(f"coalesce(octet_length(encode({v}::varchar))::varchar || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))"
    parts = [
        f"crc as (select {_crc32_table()}::bigint[] as t)",
        f"leaves as (select doc_id, coalesce('=' || lang, '') as grp, sha256({fields('text')}) as h, sha256({fields(f'''translate(text, '{UPPER}', '{LOWER}')''')}) as low, xor({crc}, 4294967295) % 3 = 0 as hit from documents, crc)",
        "spot as (select *, row_number() over (partition by grp order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by grp) as n from leaves)",
        "g0 as (select grp, pos, n, h from spot)",
        *[_level("g", k, f"g{k - 1}") for k in range(1, depth + 1)],
        f"t0 as (select '' as grp, grp as below, row_number() over (order by grp) - 1 as pos, count(*) over () as n, h from g{depth})",
        *[_level("t", k, f"t{k - 1}") for k in range(1, top + 1)],
        *[_fold("g", k) for k in range(depth)],
        *[_fold("t", k) for k in range(top)],
        "g_start as (select doc_id, h as leaf, grp, pos, case when hit then coalesce(low, h) else h end as fold, '' as beside from spot)",
        *_walk("g", "g_start", "doc_id", depth),
        f"t_start as (select w.doc_id, w.leaf, t.h as subroot, '' as grp, t.pos, w.fold, w.beside from g_walk{depth - 1} w join t0 t on w.grp = t.below)",
        *_walk("t", "t_start", "doc_id", top),
    ]
    return f"with {', '.join(parts)} select w.doc_id, w.leaf, w.subroot, r.h as root, sha256(w.beside) as proof_sha256, w.fold as folded_root, w.fold = r.h as verified from t_walk{top - 1} w, t{top} r"


MERKLE_SQL = _sql(8, 3)
