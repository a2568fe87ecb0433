"""Ordered pages and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 1, in a total order: each task keeps its first number * size rows only."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ranked(df: DataFrame, order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows with their rank from 1 and the size n of the list. `most` bounds what the one task numbers."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))


def capped(df: DataFrame, kind: str, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """The first rows of each kind, at most its cap; kinds without a cap stay whole.

    A limit per kind, not a window: every task keeps at most the cap's rows, so one kind with most rows sorts nowhere whole.
    """
    out = df.where(~F.coalesce(F.col(kind).isin(*caps), F.lit(False)))
    for name, cap in caps.items():
        out = out.unionByName(df.where(F.col(kind) == name).orderBy(*order).limit(cap))
    return out


def clamped(limit: Column, most: int = 50, usual: int = 10) -> Column:
    """How many hits a caller's text asks for: 1 to `most`, and `usual` if it is no whole number."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.trim(limit).try_cast("long"), F.lit(usual).cast("long"))))
