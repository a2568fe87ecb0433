"""What rules say of captured URLs and names: hosts, paths and queries of many kinds, put together by the ids of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.session import table
from lodestone.sources.graph import video_id

HOSTS = (
    "www.facebook.com M.Facebook.com facebook.com l.facebook.com fb.com fb.watch f.example pbs.twimg.com PBS.twimg.com video.twimg.com abs.twimg.com scontent.xx.fbcdn.net external-cph2-1.xx.fbcdn.net video-ber1-1.xx.fbcdn.net "
    "static.xx.fbcdn.net scontent.cdninstagram.com bit.ly twitter.com www.x.com mobile.twitter.com www.youtube.com youtu.be youtube-nocookie.com m.youtube.com www.facebook.com:443 t.co tinyurl.com external.xx.fbcdn.net facebook.com.example"
).split()
PATHS = (
    "/Me/posts/1 /settings/x /profile.php /groups/5/permalink/6 /events/1 /messages/t /marketplace/item /pages/x/posts/1 /me/about /allactivity /reel/ /reel/123 /watch /notes/me /photo.php /photo/ /me/videos/9 /permalink.php /media/a.jpg "
    "/profile_images/a.png /emoji/v/e.png /card_img/1/a.webp /tweet_video_thumb/a.JPG /v/t39.30808-1/a.jpg /v/t39.30808-6/a.gif /v/t51.71878-15/a.jpg /v/t15.5256-10/a.jpg /v/T1.6435-9/a.bmp /me.too/status/42 /Me/statuses/43/ /AbC_1-x"
).split()
QUERIES_OF = ("", "?fbid=1", "?story_fbid=pfbid0A&id=2", "?comment_id=3", "?s=tab", "?fbid=7&set=a.1", "?v=AbC_1", "?list=L&v=XyZ", "#frag", "?a=b c&d=é*~", "/", "?s=table", "?w=1.png")
NAMES = (
    "jane.roe.42", "MusterMarta", "mike99", "max.lang.9", "42.7", "ann", "ANN.LEE", "max.musterMann12", "a.b.c.1.2", "éva.Ürge", "x", "o'neil.kim", "1234", "jean-Luc", "A1B2", "three.4.five",
)


def built(k: Column, step: int) -> Column:
    """The URL of a number: hosts, paths and queries turn at their own speed, so that all meet."""
    pick = lambda options, by: F.get(F.array(*map(F.lit, options)), F.pmod(F.floor(k * by), F.lit(len(options))).cast("int"))
    return F.concat(F.lit("https://"), pick(HOSTS, 1), pick(PATHS, step), pick(QUERIES_OF, 3))


def captured(spark, sf_dir):
    k = F.col("event_id")
    # by inline(), as a plain column would be put into each rule's expression anew
    return table(spark, sf_dir, "events").select(k, F.inline(F.array(F.struct(built(k, 7).alias("u"), built(k + F.floor(k / 3), 7).alias("other")))))


def url_rules(spark, sf_dir):
    rows, u = captured(spark, sf_dir), F.col("u")
    return rows.select(
        "event_id", rules.is_content(u).alias("content"), rules.keeps_image(u).alias("image"), rules.harvest_keeps_image(u).alias("harvested"), rules.is_shortened(u).alias("short"),
        rules.on_own_profile(u, F.lit("me")).alias("own"), rules.reclassified(F.lit(4), u).cast("long").alias("kind"), rules.safe_extension(u).alias("ext"),
    )


def embeds(spark, sf_dir):
    rows, u = captured(spark, sf_dir), F.col("u")
    source = (1 + F.col("event_id") % 4).cast("int")
    other = F.when(F.col("event_id") % 7 == 0, u).when(F.col("event_id") % 7 == 1, F.replace(u, F.lit("https://www."), F.lit("https://m."))).when(F.col("event_id") % 7 == 2, "").otherwise(F.col("other"))
    return rows.select("event_id", rules.tweet_embed(u).alias("tweet"), rules.video_embed(u).alias("video"), rules.post_embed(u).alias("post"), U.video_id(u).alias("watch"), rules.shows_frame(source, u, other).alias("frame"))


def profile_names(spark, sf_dir):
    """Names of slugs, among them such as have the part's number in them."""
    k = F.col("p_partkey")
    slug = F.get(F.array(*[F.lit(n) for n in NAMES]), (k % len(NAMES)).cast("int"))
    slug = F.when(k % 5 == 0, F.concat(slug, F.lit("."), k.cast("string"))).when(k % 5 == 1, F.concat(slug, k.cast("string"))).otherwise(slug)
    return table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug")).select("p_partkey", "slug", T.humanise(F.col("slug")).alias("name"))


ACTORS, ACTS, OBJECTS = ("Ann Lee", "BO", "Éva commented"), (
    "shared a memory", "Shared a PRODUCT for sale", "shared a fundraiser", "commented on", "replied to", "Commented On", "added a photo", "is at", "replied", "likes", "shared a link",
), ("his own post", "her own photo.", "HIS own reel", "his own comment", "her own comment.", "Max's post", "Max's comment", "", "their own post", "a video", "his own video", "her own story", "the post")


def title_kinds(spark, sf_dir):
    """What titles of an archive's entries say of them."""
    k = F.col("event_id")
    part = lambda options: F.get(F.array(*map(F.lit, options)), F.pmod(k, F.lit(len(options))).cast("int"))
    title = F.concat_ws(" ", part(ACTORS), part(ACTS), part(OBJECTS))
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 50 != 7, title).alias("title")).select("event_id", "title", T.title_kind(F.col("title")).alias("kind"))


def feed_items(spark, sf_dir):
    """URLs as items of a feed, and whether they are the same one; the numbers of videos."""
    rows, u = captured(spark, sf_dir), F.col("u")
    form = lambda k, c: F.when(F.col("event_id") % 6 == k, c)
    other = F.coalesce(form(0, F.concat(u, F.lit("#x"))), form(1, F.replace(u, F.lit("https://www."), F.lit("https://m."))), form(2, F.concat(u, F.lit("/"))), form(3, F.upper(u)), form(4, F.replace(u, F.lit("https:"), F.lit("http:"))), F.col("other"))
    number = F.when(F.col("event_id") % 3 == 0, F.replace(u, F.lit("v=AbC_1"), F.concat(F.lit("v="), F.col("event_id").cast("string")))).otherwise(F.upper(u))
    return rows.select("event_id", rules.feed_item(u).alias("item"), (rules.feed_item(u) == rules.feed_item(other)).alias("same"), video_id(number).alias("video"))


QUERIES = {"title_kinds": title_kinds, "feed_items": feed_items, "url_rules": url_rules, "embeds": embeds, "profile_names": profile_names}


def _built(k: str) -> str:
    pick = lambda options, by: "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"][(({k}) * {by} % {len(options)} + 1)::int]"
    return f"'https://' || {pick(HOSTS, 1)} || {pick(PATHS, 7)} || {pick(QUERIES_OF, 3)}"


_HAS = lambda c, *parts: "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_URLS = f"c as (select event_id, {_built('event_id')} as u, {_built('event_id + event_id // 3')} as other from events), l as (select *, lower(u) as h from c)"
_NETLOC = lambda c: f"regexp_replace(lower(regexp_extract({c}, '^(?i:https?)://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = lambda c: f"regexp_extract({c}, '^(?i:https?)://[^/?#]*([^?#]*)', 1)"
_CONTENT_URL = " and ".join([
    _HAS("h", "facebook.com"),
    "not " + _HAS("h", "/allactivity", "facebook.com/settings", "/profile.php", "/groups/", "/events/", "/messages/", "/marketplace/", "/pages/", "/about", "l.facebook.com"),
    "not (" + _HAS("h", "fbid=") + " and not " + _HAS("h", "/posts/", "/photo", "/reel/", "/videos/", "story_fbid", "pfbid", "comment_id=") + ")",
    "not (" + _HAS("h", "/reel/?") + " and regexp_matches(h, '[?&]s=tab\\b') and not regexp_matches(h, '/reel/[0-9]+'))",
    _HAS("h", "/posts/", "pfbid", "story_fbid", "permalink", "/reel/", "fbid=", "/photo", "comment_id=", "/videos/"),
])
_TWITTER_IMAGE = f"not {_HAS('h', 'pbs.twimg.com/profile_images/', 'pbs.twimg.com/profile_banners/', '/emoji/', 'abs.twimg.com/')} and " + _HAS("h", *[f"pbs.twimg.com/{x}/" for x in ("media", "tweet_video_thumb", "ext_tw_video_thumb", "amplify_video_thumb", "card_img")], "video.twimg.com/")
_HARVESTED = f"""not contains(u, 'emoji') and not {_HAS('h', '/rsrc.php/', 'static.xx.fbcdn.net', '/v/t15.5256', '/v/t39.30808-1/', '/v/t1.6435-')} and (contains(h, 'scontent') and contains(h, 'fbcdn.net')
    or contains(h, 'fbcdn.net') and {_HAS('h', 'external.', 'external-', 'video.', 'video-')} or contains(h, 'scontent') and contains(h, 'cdninstagram.com'))"""
_STATUS = "'https?://(?:www\\.)?(?:x\\.com|twitter\\.com)/([^/?]+)/status(?:es)?/([0-9]+)'"
_QUOTED = "replace(replace(url_encode(u), '%7E', '~'), '+', '%20')"
_FB = "('facebook.com', 'fb.com', 'fb.watch', 'm.facebook.com')"
_SAME = lambda c: f"regexp_replace({_NETLOC(c)}, '^m\\.', '') || coalesce(nullif(rtrim({_PATH(c)}, '/'), ''), '/') || '?' || regexp_extract({c}, '^[^?#]*\\?([^#]*)', 1)"
_PROFILE = lambda c: f"lower(string_split(trim({_PATH(c)}, '/'), '/')[1])"
_TITLE = "list_transform(regexp_extract_all({}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:]))"
_LIST = lambda options: "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"][(event_id % {len(options)} + 1)::int]"
_SELF = _HAS("t", *[f"{x} own {y}" for y in ("post", "photo", "reel") for x in ("his", "her")])
_REPLY = _HAS("t", "replied to his own comment", "replied to her own comment")
ORACLE_SQL = {
    "title_kinds": f"""with b as (select event_id, case when event_id % 50 <> 7 then {_LIST(ACTORS)} || ' ' || {_LIST(ACTS)} || ' ' || {_LIST(OBJECTS)} end as title from events), l as (select *, lower(coalesce(title, '')) as t from b)
        select event_id, title, case when {_HAS("t", "shared a memory")} then 'memory' when {_HAS("t", "shared a product")} then 'market' when {_HAS("t", "shared a fundraiser")} then 'fundraiser' when {_REPLY} then 'self_reply' when {_SELF} then 'self_direct'
            when not {_SELF} and not {_REPLY} and {_HAS("t", "commented on", "replied to")} then 'external' else 'post' end as kind from l""",
    "feed_items": f"""with {_URLS}, o as (select event_id, u, case event_id % 6 when 0 then u || '#x' when 1 then replace(u, 'https://www.', 'https://m.') when 2 then u || '/' when 3 then upper(u) when 4 then replace(u, 'https:', 'http:') else other end as w,
            case when event_id % 3 = 0 then replace(u, 'v=AbC_1', 'v=' || event_id) else upper(u) end as n from l)
        select event_id, {_SAME('u')} as item, ({_SAME('u')}) = ({_SAME('w')}) as same, coalesce(nullif(regexp_extract(n, '(?i)facebook\\.com/reel/([0-9]+)', 1), ''), nullif(regexp_extract(n, '(?i)facebook\\.com/[^/]+/videos/([0-9]+)', 1), ''),
            regexp_extract(n, '[?&]v=([0-9]+)', 1)) as video from o""",
    "url_rules": f"""with {_URLS} select event_id, {_CONTENT_URL} as content, {_TWITTER_IMAGE} as image, {_HARVESTED} as harvested, {_NETLOC('u')} in ('goo.gl', 'bit.ly', 't.co', 'ow.ly', 'tinyurl.com', 'is.gd', 'buff.ly', 'dlvr.it') as short,
        lower(string_split({_PATH('u')}, '/')[2]) = 'me' as own, case when regexp_matches(h, '\\.(jpe?g|png|gif|webp|bmp)(\\?.*)?$') then 1 else 4 end::bigint as kind,
        case when lower(regexp_extract({_PATH('u')}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'mp4', 'mov', 'webm') then lower(regexp_extract({_PATH('u')}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) else 'jpg' end as ext from l""",
    "embeds": f"""with {_URLS}, o as (select event_id, u, 1 + event_id % 4 as source, case event_id % 7 when 0 then u when 1 then replace(u, 'https://www.', 'https://m.') when 2 then '' else other end as own from l)
        select event_id, case when regexp_matches(u, {_STATUS}) then 'https://twitter.com/' || regexp_extract(u, {_STATUS}, 1) || '/status/' || regexp_extract(u, {_STATUS}, 2) else '' end as tweet,
        case when {_NETLOC('u')} in {_FB} and {_HAS(f"lower({_PATH('u')})", '/reel/', '/watch', '/videos/', 'video.php')} then 'https://www.facebook.com/plugins/video.php?height=314&href=' || {_QUOTED} || '&show_text=false&width=560' else '' end as video,
        case when {_NETLOC('u')} in {_FB} or {_NETLOC('u')} = 'l.facebook.com' then 'https://www.facebook.com/plugins/post.php?height=600&href=' || {_QUOTED} || '&show_text=true&width=500' else '' end as post,
        case when {_NETLOC('u')} in ('youtube.com', 'youtube-nocookie.com') then regexp_extract(u, '[?&]v=([^&#]*)', 1) when {_NETLOC('u')} = 'youtu.be' then ltrim({_PATH('u')}, '/') else '' end as watch,
        case when source <> 3 then true when own = '' then true when {_SAME('u')} = {_SAME('own')} then false else not ({_PROFILE('u')} <> '' and {_PROFILE('u')} = {_PROFILE('own')}) end as frame from o""",
    "profile_names": f"""with s as (select p_partkey, {"[" + ", ".join("'" + n.replace("'", "''") + "'" for n in NAMES) + "]"}[(p_partkey % {len(NAMES)} + 1)::int] as n from part),
        n as (select p_partkey, case p_partkey % 5 when 0 then n || '.' || p_partkey when 1 then n || p_partkey else n end as slug from s),
        d as (select *, string_split(slug, '.') as parts from n),
        k as (select *, coalesce(list_max(list_transform(range(1, len(parts) + 1), lambda i: case when not regexp_matches(parts[i], '^[0-9]+$') then i end)), 0) as last from d),
        w as (select p_partkey, slug, case when not contains(slug, '.') then regexp_replace(slug, '([a-z])([A-Z])', '\\1 \\2', 'g') when last = 0 then slug else array_to_string(parts[:last], ' ') end as words from k)
        select p_partkey, slug, array_to_string({_TITLE.format('words')}, '') as name from w""",
}
