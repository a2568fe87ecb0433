"""Forms in which exports write times, texts, links and media: one row of a table gives one form, its id decides which."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import chunks as C
from lodestone.operators.pages import clamped
from lodestone.plans import texts
from lodestone.plans.views import POSTS, posts
from lodestone.session import table

COLLECTED = "2024-03-05T12:00:00Z"


def form(key: str, options: list) -> Column:
    """The option that the id chooses in turn."""
    return F.get(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (F.col(key) % len(options)).cast("int"))


def glue(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def time_ladder(spark, sf_dir):
    """An activity row's time by epoch, ISO text, relative, full and yearless dates."""
    k = F.col("page_id")
    none = F.lit(None).cast("long")
    utime = form("page_id", [k * 1000 + 1_700_000_000_000, k + 1_700_000_000, none, none, none, F.lit(5).cast("long"), none, none, none])
    iso = F.when(k % 9 == 7, "2020-05-06T07:08:09+02:00")
    raw = form("page_id", ["", "", glue(1 + k % 20, " hours ago"), "yesterday", "Today", glue("March ", 1 + k % 28, ", 2021 at 4:05 PM"), glue("December ", 1 + k % 28), "", glue("on ", 1 + k % 28, " June 2019")])
    rows = table(spark, sf_dir, "pages").select("page_id", D.resolve(utime, iso, raw, F.lit(COLLECTED)).alias("at"))
    return rows.select("page_id", F.col("at").cast("long").alias("at"))


def stamps(spark, sf_dir):
    """Stamps of a web archive and of a takeout, epochs of both kinds, and the months back to a date."""
    k = F.col("page_id")
    day = glue(F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    archive = D.archive_stamp(form("page_id", [glue("2012", day, "101112"), "20121399000000"]))
    takeout = D.takeout(form("page_id", ["2014-02-03T04:05:06+0100", " 2014-02-03 04:05:06 ", "2014-02-03 04:05:06+01:00", "no time"]))
    epoch = D.epoch_seconds(form("page_id", [k + 1_300_000_000, (k + 1_300_000_000) * 1000]))
    back = D.months_back(F.lit("2020-11-20").cast("date"), F.add_months(F.lit("2020-10-15").cast("date"), (k % 5).cast("int")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.unix_seconds(archive).alias("archive"), F.unix_seconds(takeout).alias("takeout"), epoch.alias("epoch"), back.alias("back"))
    return rows.select("page_id", "archive", "takeout", "epoch", F.size("back").cast("long").alias("months"), F.array_join(F.transform("back", lambda d: F.date_format(d, "yyyy-MM")), ",").alias("back"))


def activity_texts(spark, sf_dir):
    """What is left of an activity log's row texts, and whether they are reshares."""
    k = F.col("page_id")
    row = form("page_id", [glue("Unreadupdated his status.Words ", k, " here Public3:21 AMView"), glue("Shared a post.Words ", k, " here Friends 11:05 PM"), glue("shared a link.Words ", k, " here 3dMark as read"), glue("Words ", k, " here View")])
    own = glue("So it is ", k, " Only me 1:02 PM View")
    rows = table(spark, sf_dir, "pages").select("page_id", row.alias("row"), own.alias("own"))
    return rows.select("page_id", T.clean_activity(F.col("row")).alias("cleaned"), T.is_reshare(F.col("row")).alias("reshare"), T.clean_commentary(F.col("own")).alias("commentary"), T.plain_mentions(glue("to @[1:", F.col("page_id"), ":Ann Lee] and @[x:1:B]")).alias("mentions"))


def repaired_texts(spark, sf_dir):
    """Whole texts that were read in the wrong encoding, repaired; and those that weren't, left as they are."""
    text = F.col("content_text")
    broken = F.when(F.col("id") % 2 == 0, F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")).otherwise(glue(text, " – и"))
    return posts(spark, sf_dir).select("id", F.sha2(T.fix_encoding(broken), 256).alias("digest"))


def media_links(spark, sf_dir):
    """Video links, proxies, kinds of media and where they are kept."""
    k = F.col("page_id")
    video = form("page_id", [glue("https://www.youtube.com/attribution_link?a=x&u=%2Fwatch%3Fv%3DV", k, "%26feature%3Dshare"), glue("https://youtu.be/V", k, "?t=3"), glue("https://youtube.com/embed/V", k), glue("https://m.youtube.com/watch?list=L&v=V", k), "https://v.example/watch?v=1"])
    proxy = form("page_id", [glue("https://p.example/x?a=1&url=https%3A%2F%2Fs.example%2F", k, ".jpg"), glue("https://p.example/x?utld=s.example"), "https://s.example/plain.jpg"])
    media = form("page_id", ["https://video.twimg.com/tweet_video/a.gif", "https://pbs.twimg.com/tweet_video_thumb/a.jpg", "https://pbs.twimg.com/media/a.jpg", "https://x.example/a.m3u8"])
    efg = form("page_id", ["eyJ2ZW5jb2RlX3RhZyI6ImRhc2hfYXVkaW8ifQ", "eyJ2ZW5jb2RlX3RhZyI6ImRhc2hfdmlkZW8ifQ", "bm90IGpzb24", ""])
    name = form("page_id", [glue("photo ", k, "(1).jpg"), glue(F.repeat(F.lit("n"), 130), k, ".png"), glue("film", k, ".MOV")])
    created = F.when(k % 2 == 0, F.lit("2019-07-04 10:00:00").cast("timestamp"))
    rows = table(spark, sf_dir, "pages").select("page_id", video.alias("v"), proxy.alias("p"), media.alias("m"), glue("https://c.example/o1/v/t2/f2/m69/x.mp4?efg=", efg, "&oh=1").alias("e"), name.alias("n"), created.alias("c"))
    return rows.select(
        "page_id", U.video_link(F.col("v")).alias("video"), U.video_id(F.col("v")).alias("video_id"), U.unwrapped(F.col("p")).alias("target"), U.media_type(F.col("m")).cast("long").alias("kind"), U.file_media_type(F.col("n")).cast("long").alias("file_kind"),
        U.is_audio_stream(F.col("e")).alias("audio"), U.media_path(F.col("n"), F.col("c")).alias("path"), U.safe_name(F.col("n")).alias("safe"), U.comment_id(F.when(k % 3 == 0, F.col("n")), F.when(k % 3 == 1, F.lit("c1")), F.col("p")).alias("comment"),
    )


def embed_chunks(spark, sf_dir):
    """Inputs of chunk embeddings: the title goes before the first chunk only."""
    rows = posts(spark, sf_dir).select("id", glue("Post ", F.col("id")).alias("title"), "content_text", F.lit("").alias("reshared"))
    return C.embed_inputs(rows, "title", "content_text", "reshared").select("id", F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash")


def search_limits(spark, sf_dir):
    limit = form("page_id", [F.col("page_id").cast("string"), "ten", "-3", "0", "9999", ""])
    return table(spark, sf_dir, "pages").select("page_id", clamped(limit).cast("long").alias("most"))


QUERIES = {
    "time_ladder": time_ladder, "stamp_forms": stamps, "activity_texts": activity_texts, "repaired_texts": repaired_texts, "media_links": media_links, "embed_chunks": embed_chunks, "search_limits": search_limits,
}

_EPOCH = "epoch(timestamp '{}')::bigint"
ORACLE_SQL = {
    "time_ladder": f"""select page_id, case page_id % 9 when 0 then 1700000000 + page_id when 1 then 1700000000 + page_id when 2 then {_EPOCH.format("2024-03-05 12:00:00")} - 3600 * (1 + page_id % 20)
        when 3 then {_EPOCH.format("2024-03-04 12:00:00")} when 4 then {_EPOCH.format("2024-03-05 12:00:00")} when 5 then {_EPOCH.format("2021-03-01 16:05:00")} + 86400 * (page_id % 28)
        when 6 then {_EPOCH.format("2023-12-01 12:00:00")} + 86400 * (page_id % 28) when 7 then {_EPOCH.format("2020-05-06 05:08:09")} else {_EPOCH.format("2019-06-01 12:00:00")} + 86400 * (page_id % 28) end as at from pages""",
    "stamp_forms": f"""with b as (select page_id, list_reverse(list_filter(['2020-11', '2020-12', '2021-01', '2021-02'], lambda x, i: i <= page_id % 5)) as l from pages)
        select page_id, case when page_id % 2 = 0 then epoch(make_timestamp(2012, 1 + page_id % 12, 1 + page_id % 28, 10, 11, 12))::bigint end as archive,
        case page_id % 4 when 0 then {_EPOCH.format("2014-02-03 03:05:06")} when 1 then {_EPOCH.format("2014-02-03 04:05:06")} when 2 then {_EPOCH.format("2014-02-03 03:05:06")} end as takeout,
        page_id + 1300000000 as epoch, case when page_id % 5 = 1 then 0 else len(l) end::bigint as months, case when page_id % 5 = 1 then '' else array_to_string(l, ',') end as back from b""",
    "activity_texts": """select page_id, 'Words ' || page_id || ' here' as cleaned, page_id % 4 = 1 as reshare, 'So it is ' || page_id as commentary, 'to @Ann Lee and @[x:1:B]' as mentions from pages""",
    "repaired_texts": f"with {POSTS} select id, sha256(case when id % 2 = 0 then content_text else content_text || ' – и' end) as digest from posts",
    "media_links": """with n as (select page_id, case page_id % 3 when 0 then 'photo ' || page_id || '(1).jpg' when 1 then repeat('n', 130) || page_id || '.png' else 'film' || page_id || '.MOV' end as n,
            case page_id % 3 when 0 then 'https://s.example/' || page_id || '.jpg' when 1 then 's.example' else 'https://s.example/plain.jpg' end as target from pages)
        select page_id, case page_id % 5 when 0 then 'https://www.youtube.com/watch?v=V' || page_id when 1 then 'https://youtu.be/V' || page_id || '?t=3' when 2 then 'https://youtube.com/embed/V' || page_id
            when 3 then 'https://m.youtube.com/watch?list=L&v=V' || page_id else 'https://v.example/watch?v=1' end as video,
        case when page_id % 5 in (0, 1) then 'V' || page_id else '' end as video_id, target, [2, 3, 1, 2][(page_id % 4 + 1)::int]::bigint as kind, case when page_id % 3 = 2 then 2 else 1 end::bigint as file_kind, page_id % 4 = 0 as audio,
        'media/' || case when page_id % 2 = 0 then '2019/07' else 'unknown' end || '/' || case when page_id % 3 = 1 then substr(sha256(n), 1, 16) || '.png' else n end as path,
        case page_id % 3 when 0 then 'photo_' || page_id || '_1_.jpg' when 1 then repeat('n', 120) else n end as safe,
        case page_id % 3 when 0 then n when 1 then 'c1' else 'alc_' || substr(sha256('https://s.example/plain.jpg'), 1, 16) end as comment from n""",
    "embed_chunks": texts.ORACLE_SQL["chunk_documents"].replace(
        "select id, row_number() over (partition by id order by s) - 1 as chunk_index, length(chunk) as chars, sha256(chunk) as content_hash from p where chunk <> ''",
        """select id, i as chunk_index, sha256(case when i = 0 then 'Post ' || id || chr(10) || chr(10) || chunk else chunk end) as content_hash
        from (select id, row_number() over (partition by id order by s) - 1 as i, chunk from p where chunk <> '')""",
    ),
    "search_limits": "select page_id, case page_id % 6 when 0 then greatest(1, least(page_id, 50)) when 1 then 10 when 2 then 1 when 3 then 1 when 4 then 50 else 10 end::bigint as most from pages",
}
