"""Structured Streaming: windows with watermarks, keyed deduplication and admission with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import shared_dir
from lodestone.streaming.stateful import PROVIDER, ROCKS


def event_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Events as they come in files; the time is a timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")  # a pattern, as the path can be a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of each window and type; windows end with the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def first_of_key(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each key once within the watermark: the harvest loop's deduplication."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def distinct_keys(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, however far apart and in whatever order its rows come; the state is the keys."""
    return events.select(*keys).dropDuplicates(keys)


def longest_of_key(events: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """Each key with its longest text so far, of equal lengths the first: the harvest loop's upsert. The state is a text for each key."""
    best = F.max(F.struct(F.length(F.coalesce(text, F.lit(""))).alias("n"), (-F.col(seq)).alias("seq"), F.col(text).alias("text"))).alias("best")
    return events.groupBy(*keys).agg(best).select(*keys, (-F.col("best.seq")).alias(seq), F.col("best.text").alias(text))


#: A call that is held in state: its time in microseconds, its id and whether it was let in.
HELD = np.dtype([("at", "<i8"), ("id", "<i8"), ("let", "?")])


def admission(limit: int, span_s: int, late: bool = False):
    """For applyInPandasWithState: lets `limit` calls of a key in within a span, by (at, event_id), in whatever order they come.

    The state is the held calls, and the last times let in of those before them. New calls are put in their places among the held ones,
    and what comes after the first of them is decided anew; what changes by that is sent again. With `late`, calls that the watermark
    has passed are final and no longer held; one that comes later still is decided as the first of the held ones. `copy` numbers equal calls.
    """
    span = span_s * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, blob = state.get if state.exists else ([], b"")
        held = np.frombuffer(blob, HELD)
        new = [np.rec.fromarrays([b["at"].to_numpy(), b["event_id"].to_numpy(), np.zeros(len(b), bool)], dtype=HELD) for b in batches]
        calls = np.concatenate([held, *new])
        known = np.arange(len(calls)) < len(held)
        order = np.lexsort((~known, calls["id"], calls["at"]))
        calls, known = calls[order], known[order]
        start = len(calls) if known.all() else int(np.argmin(known))
        passed = calls["at"][:start][calls["let"][:start]]
        recent = deque([*before, *passed[-limit:].tolist()] if limit else [], maxlen=limit)
        let = []
        for at in calls["at"][start:].tolist():
            let.append(limit > 0 and (len(recent) < limit or recent[0] < at - span))
            if let[-1]:
                recent.append(at)
        let = np.array(let, bool)
        sent = start + np.flatnonzero(~known[start:] | (let != calls["let"][start:]))
        calls["let"][start:] = let
        first = np.r_[True, calls[["at", "id"]][1:] != calls[["at", "id"]][:-1]]  # of equal calls
        copy = np.arange(len(calls)) - np.maximum.accumulate(np.where(first, np.arange(len(calls)), 0))
        done = int(np.searchsorted(calls["at"], state.getCurrentWatermarkMs() * 1000)) if late else 0
        final = calls["at"][:done][calls["let"][:done]].tolist()
        state.update(([*before, *final][-limit:] if limit else [], calls[done:].tobytes()))
        out = calls[sent]
        yield pd.DataFrame({"event_id": out["id"], "user_id": key[0], "at": out["at"], "copy": copy[sent], "admitted": out["let"]})

    return run


def admitted(events: DataFrame, limit: int = 3, span_s: int = 86_400, late: str | None = None) -> DataFrame:
    """(event_id, user_id, at, copy, admitted), of which the last row sent of a CALL holds.

    Without `late` calls can come in any order, and the state is all calls in 17 bytes each; with it, those up to so much behind the latest.
    """
    calls = (events.withWatermark("ts", late) if late else events).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    schema = "event_id bigint, user_id bigint, at bigint, copy bigint, admitted boolean"
    run = admission(limit, span_s, bool(late))
    return calls.groupBy("user_id").applyInPandasWithState(run, schema, "before array<bigint>, held binary", "append", GroupStateTimeout.NoTimeout)


#: What tells the calls of `admitted` apart.
CALL = ["user_id", "event_id", "at", "copy"]


def run(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None], rocks: bool = False) -> None:
    """Run over all that is there, from where the checkpoint in `folder` stands; `rocks` for state with maps and timers, which needs that store."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    if rocks:
        conf.set(PROVIDER, ROCKS)
    try:
        started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        if rocks and before is not None:
            conf.set(PROVIDER, before)
        elif rocks:
            conf.unset(PROVIDER)
    started.awaitTermination()


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None, rocks: bool = False) -> DataFrame:
    """Run over all that is there, then read the sink: with `complete` the last state, with `append` and `update` all that was sent, or of `keys` the last."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    run(stream, mode, folder, write, rocks)
    sent = spark.read.parquet(f"{folder}/out")
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        sent = sent.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return sent.select(*stream.columns)
