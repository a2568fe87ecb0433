"""Streams whose state is kept by key with timers: an answer cache, and a harvest that forgets keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def preferred(rows: dict[str, tuple[int, int]], asked: str, premium: str) -> str | None:
    """Which model's answer is given to one who asks for `asked`: its own, else the latest of its family, else the premium one."""
    if asked in rows:
        return asked
    family = [m for m in rows if m.startswith(asked) or asked.startswith(m)]
    if family:
        return max(family, key=rows.get)
    return premium if premium in rows and asked != premium else None


class Cache(StatefulProcessor):
    """Each model's latest answer to a question; a premium one evicts all that were written before it.

    Which of two writes is later is told by (at, event_id), not by the order in which they come, so files can come in any order. With a
    time to live, an answer goes once the watermark is so far behind it.
    """

    def __init__(self, asked: str, premium: str, live_s: int | None):
        self.asked, self.premium, self.live = asked, premium, live_s and live_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "model string", "at bigint, event_id bigint")
        self.given = handle.getValueState("given", "model string, event_id bigint")

    def rows(self) -> dict[str, tuple[int, int]]:
        return {m: (at, event) for (m,), (at, event) in self.answers.iterator()}

    def tell(self, key: tuple, rows: dict) -> Iterator[pd.DataFrame]:
        """The answer given now, if it isn't the one given before."""
        model = preferred(rows, self.asked, self.premium)
        now = (model, rows[model][1] if model else None)
        if now != (tuple(self.given.get()) if self.given.exists() else (None, None)):
            self.given.update(now)
            yield pd.DataFrame({"question": [key[0]], "model": pd.Series([now[0]], dtype="object"), "event_id": pd.Series([now[1]], dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.rows()
        known = dict(held)
        for batch in rows:
            for model, at, event in zip(batch["model"], batch["at"].tolist(), batch["event_id"].tolist()):
                held[model] = max(held.get(model, (at, event)), (at, event))
        if self.premium in held:
            held = {m: write for m, write in held.items() if m == self.premium or write > held[self.premium]}
        for model in known.keys() - held.keys():
            self.answers.removeKey((model,))
        for model, write in held.items():
            if known.get(model) != write:
                self.answers.updateValue((model,), write)
                if self.live:
                    self.handle.registerTimer((write[0] + self.live) // 1000 + 1)
        yield from self.tell(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.rows()
        over = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for model in [m for m, (at, _) in held.items() if at + self.live < over]:
            self.answers.removeKey((model,))
            del held[model]
        yield from self.tell(key, held)

    def close(self) -> None:
        pass


def cache(writes: DataFrame, asked: str, premium: str = "premium", live_s: int | None = None, late: str = "1 day") -> DataFrame:
    """(question, model, event_id): the answer to each question as it changes; null if none is left. `writes` has question, model, event_id, ts.

    Only where answers end is there a watermark, and are writes dropped that it has passed.
    """
    writes = writes.withWatermark("ts", late) if live_s else writes
    rows = writes.where("model is not null and ts is not null").select("question", "model", "event_id", "ts", F.unix_micros("ts").alias("at"))
    rows, mode = rows.groupBy("question"), "EventTime" if live_s else "None"
    return rows.transformWithStateInPandas(Cache(asked, premium, live_s), outputStructType="question bigint, model string, event_id bigint", outputMode="Update", timeMode=mode)


class Harvest(StatefulProcessor):
    """Each key's longest text so far, of equal lengths the first; it is sent when it changes. A key is forgotten `live_s` after its last row.

    A group is a bucket of keys, whose state is maps by key: a call, frames and batches of output for each key would cost far more than its rows.
    The longest texts of a batch's rows of a bucket are in memory together. A row without a `seq` comes after those with one.
    """

    def __init__(self, live_s: int | None):
        self.live = live_s and live_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "key string", "n bigint, known boolean, seq bigint")
        self.last = handle.getMapState("last", "key string", "at bigint")
        self.due = handle.getMapState("due", "ms bigint", "keys array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tops, lasts, sent, ends = {}, {}, [], {}
        for batch in rows:
            for item, n, known, seq, body in zip(batch["key"], batch["n"].tolist(), batch["known"].tolist(), batch["seq"].tolist(), batch["body"]):
                if item not in tops or (n, known, -seq) > tops[item][0]:
                    tops[item] = (n, known, -seq), body
            if self.live:
                for item, at in zip(batch["key"], batch["at"].tolist()):
                    lasts[item] = max(lasts.get(item, at), at)
        for item, (top, body) in tops.items():
            best = self.best.getValue((item,))
            if best is None or top > (best[0], best[1], -best[2]):
                self.best.updateValue((item,), (*top[:2], -top[2]))
                sent.append((item, -top[2] if top[1] else None, body))
        if sent:
            yield pd.DataFrame(sent, columns=["key", "seq", "body"], dtype="object")
        for item, at in lasts.items():
            last = self.last.getValue((item,))
            if last is None or at > last[0]:
                self.last.updateValue((item,), (at,))
                ends.setdefault(at // 1000 + self.live, []).append(item)
        for end, items in ends.items():
            known = self.due.getValue((end,))
            self.due.updateValue((end,), ([*known[0], *items] if known else items,))
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        for item in (self.due.getValue((end,)) or ((),))[0]:
            # a timer of an earlier row does nothing
            last = self.last.getValue((item,))
            if last is not None and last[0] // 1000 + self.live <= end:
                self.best.removeKey((item,))
                self.last.removeKey((item,))
        self.due.removeKey((end,))
        yield from ()

    def close(self) -> None:
        pass


def keyed(items: DataFrame, buckets: int = 1024) -> DataFrame:
    """What Harvest reads, by bucket; `seq` is never null, as pandas would make floats of it."""
    seq = [F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("seq").isNotNull().alias("known")]
    return items.select(F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), "key", *seq, "body", F.length(F.coalesce("body", F.lit(""))).cast("long").alias("n"), *[c for c in items.columns if c in ("ts", "at")])


def harvest(items: DataFrame, live_s: int | None = None, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """(key, seq, body) as it improves. `items` has key, seq, body and ts; the state is two numbers a key, not its text.

    Only where keys are forgotten is there a watermark, and are rows dropped that it has passed.
    """
    items = items.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")) if live_s else items.drop("ts")
    rows, mode = keyed(items, buckets).groupBy("bucket"), "EventTime" if live_s else "None"
    return rows.transformWithStateInPandas(Harvest(live_s), outputStructType="key string, seq bigint, body string", outputMode="Update", timeMode=mode)
