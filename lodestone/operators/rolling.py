"""Counts over trailing spans of time, and admission under a limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_counts(events: DataFrame, event_id: str, at: str, span: int, cell: int, keys: list[str] | None = None, out: str = "n") -> DataFrame:
    """(event_id, keys, out): how many other events of the same keys lie in the `span` up to each event, both ends included.

    C(t), the number of events up to t, is the events of earlier cells plus those up to t in t's own cell, and the count is
    C(t) - C(t - span - 1) - 1. Each cell of time is a window of its own; only the cells' totals, one row for each, are summed over all time.
    """
    keys = keys or []
    t = F.col(at)
    probes = events.select(event_id, *keys, F.explode(F.array(F.struct(t.alias("t"), F.lit(1).alias("real")), F.struct((t - span - 1).alias("t"), F.lit(0).alias("real")))).alias("p"))
    probes = probes.select(event_id, *keys, "p.t", "p.real").withColumn("cell", F.floor(F.col("t") / cell))
    totals = probes.groupBy(*keys, "cell").agg(F.sum("real").alias("cell_n"))
    before = F.sum("cell_n").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("cell_n")
    within = F.sum("real").over(Window.partitionBy(*keys, "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    summed = probes.withColumn("within", within).join(totals.select(*keys, "cell", before.alias("before")), [*keys, "cell"])
    c = (F.col("within") + F.col("before")) * F.when(F.col("real") == 1, 1).otherwise(-1)
    return summed.groupBy(event_id, *keys).agg((F.sum(c) - 1).cast("long").alias(out))


def admit(limit: int, span: int):
    """For batches sorted by (key, at): whether each call is let in. Calls that aren't take up no room; the state is `limit` times at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = object(), deque()
        for batch in batches:
            out = []
            for k, at in zip(batch.key, batch["at"]):
                if k != key:
                    key, recent = k, deque()
                while recent and recent[0] < at - span:
                    recent.popleft()
                let = len(recent) < limit
                if let:
                    recent.append(at)
                out.append(let)
            yield pd.DataFrame({"event_id": batch.event_id, "admitted": out})

    return run


def admitted(events: DataFrame, event_id: str, key: str, at: str, limit: int, span: int) -> DataFrame:
    """(event_id, admitted). Whether a call is let in depends on all before it, so a key is one sorted stream with bounded state."""
    rows = events.select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), F.col(at).alias("at")).where("key is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(admit(limit, span), "event_id bigint, admitted boolean")
