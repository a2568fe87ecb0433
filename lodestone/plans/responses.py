"""Stories of captured responses: JSON of several shapes around the ids, times and properties of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.session import table
from lodestone.sources import story_trees

#: Shapes of responses; @k, @u, @t and @p stand for an event's id, user, second and properties.
SHAPES = (
    '{"a":{"creation_time":@t,"post_id":"@k","x":[{"image":{"uri":"https://i.example/@k.jpg"}},{"image":{"uri":"data:x"}}]}}',
    '[{"hd_src":"https://v.example/@k.mp4","id":"n@k","publish_time":"@t","url":"https://www.facebook.com/a/posts/@k"},{"id":"m@k","publish_time":@t,"url":5}]',
    '{"creation_time":@t000,"story_id":" s@k "}\n{"fbid":@k,"y":{"created_time":"2020-05-06T07:08:09+02:00","id":"c@k","playable_url":"http://v.example/@k"},"z":[[{"sd_src":"http://w.example/@u"}]]}',
    'for (;;);\n{"__typename":"Story","created_time":null,"id":@k,"publishTime":"soon","viewer_image":{"uri":"https://i.example/@u"}}',
    '{"data":[[{"node":{"creation_time":@t,"post_id":@k,"sub":{"creation_time":7,"image":{"uri":"http://i.example/@k"},"post_id":"@k","token":"@u"}}}]]}',
    '{"broken":[1,{"creation_time":@t,"token":"@k"}',
    "[]",
    '{"creation_time":-5,"token":"t@k","v":{"creation_time":"","token":"e@k"},"w":{"creation_time":"2021-02-03T04:05:06Z","id":"i@k","post_id":"","token":"z@k"}}',
    '{"creation_time":@t.75,"large_image":{"uri":"https://l.example/@k"},"legacy_story_api_id":"L@u","preferred_image":{"uri":7},"token":"t@k"}',
    '{"creation_time":@t,"props":@p,"token":"@u","x":{"__typename":"Photo","browser_native_hd_url":"https://n.example/@k","id":"@k"}}',
    '{"browser_native_sd_url":"https://nobody.example/@k","creation_time":true}',
)


def responses(spark, sf_dir):
    k, text = F.col("event_id"), F.get(F.array(*map(F.lit, SHAPES)), F.pmod("event_id", F.lit(len(SHAPES))).cast("int"))
    for mark, value in (("@k", k), ("@u", F.col("user_id")), ("@t", F.unix_timestamp("ts")), ("@p", F.coalesce("props", F.lit("null")))):
        text = F.replace(text, F.lit(mark), F.coalesce(value.cast("string"), F.lit("0")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def story_times(spark, sf_dir):
    return story_trees.times(responses(spark, sf_dir), "text", "event_id")


def story_media(spark, sf_dir):
    return story_trees.media(responses(spark, sf_dir), "text", "event_id")


QUERIES = {"story_times": story_times, "story_media": story_media}

_SHAPES = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SHAPES) + "]"
_NODES = rf"""t as (select event_id, replace(replace(replace(replace({_SHAPES}[(event_id % {len(SHAPES)} + 1)::int], '@k', event_id::varchar), '@u', coalesce(user_id::varchar, '0')), '@t', coalesce(epoch(date_trunc('second', ts))::bigint::varchar, '0')),
    '@p', coalesce(props, 'null')) as text from events),
l as (select event_id, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from t),
j as (select l.event_id, l.n, x.id, x.fullkey, x.value as v from l, json_tree(case when json_valid(l.line) then l.line end) x where x.type = 'OBJECT'),
f as (select *, json_type(v, '$.url') = 'VARCHAR' as linked, v->>'$.url' as url, v->>'$.id' as bare from j),
o as (select *, list_distinct(list_filter([trim(v->>'$.post_id'), trim(v->>'$.legacy_story_api_id'), trim(v->>'$.story_id'), trim(v->>'$.fbid'), trim(v->>'$.token'),
    case when linked or v->>'$.__typename' in ('Story', 'Post') then trim(bare) end, case when linked and contains(url, 'facebook.com') then url end], lambda s: s is not null and s <> '')) as own from f)"""
_FIRST = lambda what: "case " + " ".join(f"when v->>'$.{k}' is not null then {what.format(k)}" for k in ("creation_time", "created_time", "publish_time", "publishTime")) + " end"
ORACLE_SQL = {
    "story_times": rf"""with {_NODES}, r as (select *, {_FIRST("v->>'$.{}'")} as raw, {_FIRST("json_type(v, '$.{}')")} as kind from o),
        d as (select *, case when regexp_matches(raw, '^[0-9]+$') or kind in ('DOUBLE', 'BIGINT', 'UBIGINT') then try_cast(raw as double) end as number from r),
        a as (select *, case when number is not null then floor(case when number > 1e12 then number / 1000 else number end)::bigint else epoch(try_cast(raw as timestamptz))::bigint end as sec from d),
        u as (select event_id, n, id, sec, unnest(own) as post from a where sec > 0)
        select event_id, post, arg_min(sec, (n, id)) as at from u group by all""",
    "story_media": rf"""with {_NODES}, m as (select event_id, n, fullkey, unnest([{", ".join(f"case when json_type(v, '$.{k}.uri') = 'VARCHAR' then v->>'$.{k}.uri' end" for k in ("image", "large_image", "viewer_image", "preferred_image"))},
            {", ".join(f"case when json_type(v, '$.{k}') = 'VARCHAR' then v->>'$.{k}' end" for k in ("playable_url", "playable_url_quality_hd", "browser_native_hd_url", "browser_native_sd_url", "hd_src", "sd_src"))}]) as url from o),
        s as (select event_id, n, fullkey, case when len(own) > 0 then own else [bare] end as ids from o
            where len(own) > 0 or json_type(v, '$.id') = 'VARCHAR' and bare <> '' and (json_exists(v, '$.creation_time') or json_exists(v, '$.created_time') or json_exists(v, '$.publish_time'))),
        c as (select m.event_id, m.n, m.fullkey, m.url, arg_max(s.ids, length(s.fullkey)) as ids from m join s on m.event_id = s.event_id and m.n = s.n
            and (m.fullkey = s.fullkey or starts_with(m.fullkey, s.fullkey || '.') or starts_with(m.fullkey, s.fullkey || '[')) where m.url like 'http%' group by all)
        select distinct event_id, unnest(ids) as post, url from c""",
}
