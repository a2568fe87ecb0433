"""As-of joins with a bounded gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(rows: DataFrame, others: DataFrame, key: str, at: str, tie: str, values: list[str], gap: int, strict: bool) -> DataFrame:
    """`rows` with `values` of the latest row of `others` of the same key at or (strict) before it, where that is at most `gap` ago; else null.

    Of several at one time the largest `tie` wins. Time is cut into spans of `gap`: a match lies in a row's own span or the one
    before, so each of `others` goes to two spans and each (key, span) is a window of its own. A key with a third of all rows
    spreads over as many tasks as it has spans.
    """
    span = F.floor(F.col(at) / gap)
    left = rows.withColumn("_span", span).withColumn("_row", F.struct(*rows.columns)).select(key, "_span", F.col(at).alias("_at"), "_row", F.lit(None).cast(others.select(F.struct(at, tie, *values)).schema[0].dataType).alias("_other"))
    right = others.select(key, F.explode(F.array(span, span + 1)).alias("_span"), F.col(at).alias("_at"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(F.col(at), F.col(tie), *values).alias("_other"))
    w = Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    # structs compare by time, then tie: the largest up to here is the latest
    found = left.unionByName(right).withColumn("_other", F.max("_other").over(w)).where("_row is not null")
    near = F.col(f"_other.{at}") >= F.col("_at") - gap
    return found.select("_row.*", *[F.when(near, F.col(f"_other.{v}")).alias(v) for v in values], F.when(near, F.col("_at") - F.col(f"_other.{at}")).alias("gap"))
