"""One row of each key: longest, newest, first or last; most frequent value; numbered repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], by: list[Column], most: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) `by`.

    An aggregate over structs, not a window: maxima are taken before the shuffle, so a key with most of the rows costs no more.
    `by` must be a total order within a key, and nulls come first in it.
    """
    named = [c.alias(f"_{i}") for i, c in enumerate(by)]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(F.struct(*named).alias("by"), F.struct(*rest).alias("row"))
    pick = F.max if most else F.min
    return df.groupBy(*keys).agg(pick(packed).alias("p")).select(*keys, "p.row.*").select(*df.columns)


def longest(df: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """The row with the longest text; of equal lengths the first."""
    return best(df, keys, [F.length(text), -F.col(seq)])


def newest(df: DataFrame, keys: list[str], stamp: str, seq: str) -> DataFrame:
    return best(df, keys, [F.col(stamp), -F.col(seq)])


def first(df: DataFrame, keys: list[str], *seq: str) -> DataFrame:
    return best(df, keys, [F.col(c) for c in seq], most=False)


def last(df: DataFrame, keys: list[str], *seq: str) -> DataFrame:
    return best(df, keys, [F.col(c) for c in seq])


def mode(df: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, n): the most frequent value; of equally frequent ones that seen first."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(1).select(value, "n")


def numbered(df: DataFrame, key: str, seq: list[str], out: str) -> DataFrame:
    """`out`: the key, and for its second row on key_2, key_3 and so on.

    Keys with one row, nearly all as a rule, skip the sort.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    joined = df.join(counts, key)
    k = F.row_number().over(Window.partitionBy(key).orderBy(*seq))
    name = F.col(key).cast("string")
    many = joined.where("_n > 1").withColumn(out, F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
    return joined.where("_n = 1").withColumn(out, name).unionByName(many).drop("_n")
