"""Unique slugs: a slug that is taken gets -2, -3 and so on, past those that are taken literally."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import apart


def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (family, seq). What is kept from row to row are the slugs of the family at hand."""
    family, taken, upto = None, set(), {}
    for batch in batches:
        out = []
        for root, base in zip(batch.family, batch.base):
            if root != family:
                family, taken, upto = root, set(), {}
            slug, k = base, upto.get(base, 2)
            while slug in taken:
                slug, k = f"{base}-{k}", k + 1
            upto[base] = k
            taken.add(slug)
            out.append(slug)
        yield batch[["id"]].assign(slug=out)


def unique(df: DataFrame, base: str, seq: list[str], stem: int = 0) -> DataFrame:
    """`df` (with id) and its `slug`.

    Only slugs that are equal but for numbers at their ends can collide; families of one row keep theirs without a sort.
    `stem` characters that all begin with, such as a date, are not such numbers.
    """
    rest = F.expr(f"substring({base}, {stem + 1})")
    df = df.withColumn("family", F.concat(F.substring(base, 1, stem), F.regexp_replace(rest, r"(-\d+)+$", "")))
    counts = df.groupBy("family").agg(F.count("*").alias("_n")).select(apart("family"), "_n")
    df = df.join(counts, "family")
    many = df.where("_n > 1").select("family", "id", F.col(base).alias("base"), *[c for c in seq if c != "id"]).repartition("family").sortWithinPartitions("family", *seq)
    slugs = many.mapInPandas(assign, "id bigint, slug string")
    return df.join(slugs, "id", "left").withColumn("slug", F.coalesce("slug", base)).drop("family", "_n")
