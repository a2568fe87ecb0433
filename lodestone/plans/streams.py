"""Windows over events, rate limits, and the same as streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lodestone.operators import rolling
from lodestone.plans.views import ATTEMPTS, attempts, micros
from lodestone.session import shared_dir, table
from lodestone.streaming import events as S
from lodestone.streaming import snapshots, stateful

HOUR, DAY = 3_600_000_000, 86_400_000_000
LIMIT = 3


def window_times(df):
    out = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.select(F.date_format("w.start", out).alias("start"), F.date_format("w.end", out).alias("stop"), *[c for c in df.columns if c != "w"])


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(spark, sf_dir):
    return window_times(S.tumbling(events(spark, sf_dir)))


def sliding_counts(spark, sf_dir):
    return window_times(S.sliding(events(spark, sf_dir), "2 days", "1 day"))


def session_counts(spark, sf_dir):
    return window_times(S.sessions(events(spark, sf_dir)))


def late_filtered(spark, sf_dir):
    """Events that come over a day after the latest of those before them in order of id, per type."""
    rows = events(spark, sf_dir).select("event_id", "event_type", (micros(F.col("ts")) - F.when(F.col("event_id") % 10 == 0, 3 * DAY).otherwise(0)).alias("at"))
    # the latest so far: within a thousand ids a window, before them the maxima of thousands
    from pyspark.sql import Window

    rows = rows.withColumn("block", F.floor(F.col("event_id") / 1000))
    tops = rows.groupBy("event_type", "block").agg(F.max("at").alias("top"))
    before = F.max("top").over(Window.partitionBy("event_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    within = F.max("at").over(Window.partitionBy("event_type", "block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", within).join(tops.select("event_type", "block", before.alias("before")), ["event_type", "block"])
    latest = F.greatest("within", "before")
    return rows.where(latest.isNull() | (F.col("at") >= latest - DAY)).groupBy("event_type").agg(F.count("*").alias("kept"))


def ip_window(spark, sf_dir):
    return rolling.trailing_counts(attempts(spark, sf_dir), "event_id", "micros", DAY, HOUR, ["ip"], "seen")


def site_window(spark, sf_dir):
    return rolling.trailing_counts(attempts(spark, sf_dir), "event_id", "micros", DAY, HOUR, out="seen")


def premium_quota(spark, sf_dir):
    """Premium calls, and whether their quota of one in 24 hours was free; the gate is on the words too."""
    calls = attempts(spark, sf_dir).where("premium and k >= 6 and ip is not null")
    return rolling.trailing_counts(calls, "event_id", "micros", DAY, HOUR, ["ip"], "seen").select("event_id", (F.col("seen") < 1).alias("free"))


def admitted(spark, sf_dir):
    return rolling.admitted(attempts(spark, sf_dir), "event_id", "ip", "micros", LIMIT, DAY)


def stream(spark, sf_dir):
    return S.event_stream(spark, f"{sf_dir}/events.parquet")


def stream_tumbling(spark, sf_dir):
    return window_times(S.drained(S.tumbling(stream(spark, sf_dir)), "complete"))


def stream_sessions(spark, sf_dir):
    return window_times(S.drained(S.sessions(stream(spark, sf_dir), late="60 days"), "complete"))


def stream_dedup(spark, sf_dir):
    return S.drained(S.distinct_keys(stream(spark, sf_dir), ["user_id", "event_type"]), "append")


def stream_longest(spark, sf_dir):
    return S.drained(S.longest_of_key(stream(spark, sf_dir), ["user_id", "event_type"], "props", "event_id"), "update", ["user_id", "event_type"])


def stream_admitted(spark, sf_dir):
    return S.drained(S.admitted(stream(spark, sf_dir), LIMIT), "append", S.CALL).select("event_id", "user_id", "admitted")


#: A question's model; premium answers are rare, so that others are left after the last of them.
MODELS = ("base", "base-3", "base-3-2025", "other", "base-4")


def cache_writes(events):
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 5).cast("int"))
    model = F.when(F.col("event_id") % 29 == 0, "premium").otherwise(model)
    return events.select((F.col("user_id") % 60).alias("question"), model.alias("model"), "event_id", "ts").where("question % 4 <> 1 or model <> 'base-3'")


def stream_cache(spark, sf_dir):
    """What each question's cache gives to one who asks for base-3, after all writes."""
    sent = S.drained(stateful.cache(cache_writes(stream(spark, sf_dir)), "base-3"), "update", ["question"], rocks=True)
    return sent.where("model is not null")


def stream_harvest(spark, sf_dir):
    """Each key with its longest text, as stream_longest, from state that holds no texts."""
    items = stream(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("body"), "ts")
    return S.drained(stateful.harvest(items), "update", ["key"], rocks=True)


def keyed_snapshots(spark, sf_dir):
    """The last snapshot of a stream that ends after the files that are there, and goes on from its checkpoint when more have come."""
    folder = f"{shared_dir(spark)}/snapshots-{uuid4().hex}"
    keys, events = ["user_id", "event_type"], table(spark, sf_dir, "events")
    for some in ("event_id % 3 = 0", "event_id % 3 <> 0 or event_id is null"):
        events.where(some).repartition(4).write.mode("append").parquet(f"{folder}/in")
        rows = S.longest_of_key(S.event_stream(spark, f"{folder}/in", files=1), keys, "props", "event_id")
        S.run(rows, "update", folder, snapshots.sink(f"{folder}/out", keys, fold=3))
    return snapshots.read(spark, f"{folder}/out", keys)


QUERIES = {
    "tumbling_counts": tumbling_counts, "sliding_counts": sliding_counts, "session_counts": session_counts, "late_filtered": late_filtered, "ip_window_count": ip_window, "site_window_count": site_window,
    "premium_quota": premium_quota, "admitted_attempts": admitted, "stream_tumbling": stream_tumbling, "stream_sessions": stream_sessions, "stream_dedup": stream_dedup, "stream_longest": stream_longest, "stream_admitted": stream_admitted,
    "stream_cache": stream_cache, "stream_harvest": stream_harvest, "keyed_snapshots": keyed_snapshots,
}

_AT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_TUMBLING = f"select {_AT.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} as start, {_AT.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts) + interval 1 day')} as stop, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2, 3"
_SESSIONS = f"""with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 6 hours, true)::int as fresh from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g)
    select {_AT.format('min(ts)')} as start, {_AT.format('max(ts) + interval 6 hours')} as stop, user_id, count(*) as n from s group by user_id, k"""
_ADMITTED = f"""with recursive {ATTEMPTS}, e as (select event_id, ip, micros as m, row_number() over (partition by ip order by micros, event_id) as rn from attempts),
    r as (select ip, rn, event_id, true as admitted, [m] as adm from e where rn = 1
        union all select e.ip, e.rn, e.event_id, len(list_filter(r.adm, lambda x: x >= e.m - {DAY})) < {LIMIT},
            case when len(list_filter(r.adm, lambda x: x >= e.m - {DAY})) < {LIMIT} then list_append(list_filter(r.adm, lambda x: x >= e.m - {DAY}), e.m) else r.adm end from r join e on e.ip = r.ip and e.rn = r.rn + 1)
    select event_id, {{}}admitted from r"""
ORACLE_SQL = {
    "tumbling_counts": _TUMBLING,
    "stream_tumbling": _TUMBLING,
    "sliding_counts": f"with s as (select date_trunc('day', ts) - to_days(o) as start from events, (select unnest([0, 1]) as o)) select {_AT.format('start')} as start, {_AT.format('start + interval 2 days')} as stop, count(*) as n from s group by 1, 2",
    "session_counts": _SESSIONS,
    "stream_sessions": _SESSIONS,
    "late_filtered": f"""with r as (select event_id, event_type, epoch_us(ts) - case when event_id % 10 = 0 then {3 * DAY} else 0 end as m from events), l as (select *, max(m) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding) as latest from r)
        select event_type, count(*) as kept from l where latest is null or m >= latest - {DAY} group by 1""",
    "ip_window_count": f"with {ATTEMPTS} select event_id, ip, count(*) over (partition by ip order by micros range between {DAY} preceding and current row) - 1 as seen from attempts",
    "site_window_count": f"with {ATTEMPTS} select event_id, count(*) over (order by micros range between {DAY} preceding and current row) - 1 as seen from attempts",
    "premium_quota": f"with {ATTEMPTS} select event_id, count(*) over (partition by ip order by micros range between {DAY} preceding and current row) - 1 < 1 as free from attempts where premium and k >= 6 and ip is not null",
    "admitted_attempts": _ADMITTED.format(""),
    "stream_admitted": _ADMITTED.format("ip as user_id, "),
    "stream_dedup": "select distinct user_id, event_type from events",
}
ORACLE_SQL["stream_longest"] = "select user_id, event_type, event_id, props from events qualify row_number() over (partition by user_id, event_type order by length(coalesce(props, '')) desc, event_id) = 1"
ORACLE_SQL["keyed_snapshots"] = ORACLE_SQL["stream_longest"]
ORACLE_SQL["stream_harvest"] = "select user_id || '/' || event_type as key, event_id as seq, props as body from events qualify row_number() over (partition by user_id, event_type order by length(coalesce(props, '')) desc, event_id) = 1"
ORACLE_SQL["stream_cache"] = f"""with w as (select user_id % 60 as question, case when event_id % 29 = 0 then 'premium' else {list(MODELS)}[(event_id % 5 + 1)::int] end as model, ts, event_id from events),
    l as (select question, model, max((ts, event_id)) as last from w where question % 4 <> 1 or model <> 'base-3' group by 1, 2),
    s as (select a.question, a.model, a.last from l a left join l p on p.question = a.question and p.model = 'premium' where a.model = 'premium' or p.last is null or a.last > p.last),
    r as (select *, case when model = 'base-3' then 1 when starts_with(model, 'base-3') or starts_with('base-3', model) then 2 when model = 'premium' then 3 end as rank from s)
    select question, model, last[2] as event_id from r where rank is not null qualify row_number() over (partition by question order by rank, last desc) = 1"""
