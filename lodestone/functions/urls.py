"""URL functions: identity, canonical forms and identifiers, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

# Query parameters that don't change which post a URL names.
COMMENT_PARAMS = ("comment_id", "reply_comment_id")
TRACKING_PARAMS = ("__cft__", "__tn__", "eid", "refid", "refsrc")
# Paths of images that aren't a post's own.
FOREIGN_IMAGES = r"/v/t51\.|/v/t15\.5256|/v/t39\.30808-1/|/v/t39\.2081-6/|/v/t1\.6435-|/v/t45\.1600|/m1/v/t6/"
VIDEO_VARIANT = r"(?i)/o1/v/t2/f2/m\d+/"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(host(url), F.lit("")), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def netloc(url: Column) -> Column:
    """The host with what stands beside it, in lower case; also of URLs that a strict reading refuses."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def site(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def loose_path(url: Column) -> Column:
    """The path, without parameters of its last part; also of URLs that a strict reading refuses."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def first_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^/+([^/]+)", 1)


def param(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null where there is none."""
    value = F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(value), value)


def quote(c: Column) -> Column:
    """As a form encodes it: blanks are +, ~ stays, * doesn't."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent(c: Column) -> Column:
    """As a part of a URL: blanks are %20."""
    return F.replace(quote(c), F.lit("+"), F.lit("%20"))


def without_params(url: Column, names: tuple[str, ...]) -> Column:
    """The URL without its fragment and these parameters; of a parameter that repeats the first stays."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    key = lambda p: F.regexp_extract(p, r"^([^=]*)", 1)
    keys = F.transform(pairs, key)
    kept = F.filter(pairs, lambda p, i: (~key(p).isin(*names)) & (F.array_position(keys, key(p)) == i + 1))
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    kept = F.transform(kept, lambda p: F.concat(quote(plain(key(p))), F.lit("="), quote(plain(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)))))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def post_key(url: Column) -> Column:
    """The URL by which a comment and its post, or two visits of a post, are the same."""
    return without_params(url, COMMENT_PARAMS + TRACKING_PARAMS)


def same_page(url: Column) -> Column:
    """For comparison only: no scheme, www. or m., no fragment and no slash at the end; the query stays."""
    out = F.regexp_replace(F.lower(F.regexp_replace(url, "#.*$", "")), r"^https?://(www\.|m\.)?", "")
    return F.regexp_replace(F.regexp_replace(out, r"/+\?", "?"), "/+$", "")


def status_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/status(?:es)?/(\d+)", 1), F.lit(""))


def status_handle(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:x|twitter)\.com/([^/]+)/status/", 1), F.lit(""))


def post_id(url: Column) -> Column:
    """The id in a post's URL; the first form that matches decides."""
    found = lambda pattern: F.nullif(F.regexp_extract(path(url), pattern, 1), F.lit(""))
    forms = (r"/posts/(pfbid[A-Za-z0-9]+)", r"/posts/(\d+)", r"/reel/(\d+)", r"/videos/(\d+)", r"/photo/(\d+)")
    return F.coalesce(*[param(url, p) for p in ("pfbid", "story_fbid", "fbid")], *[found(f) for f in forms])


def short_digest(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))


def activity_id(url: Column, utime: Column, raw_time: Column, text: Column) -> Column:
    """A post's id that survives another export: a numeric id, else a digest of time and text."""
    numeric = F.when(post_id(url).rlike(r"^\d+$"), post_id(url))
    head = F.substring(text, 1, 500)
    seed = (
        F.when(utime.isNotNull() & (utime != 0), F.concat(utime.cast("string"), F.lit("|"), head))
        .when(raw_time.isNotNull() & (raw_time != ""), F.concat(raw_time, F.lit("|"), head))
        .when(text != "", F.substring(text, 1, 1000)).otherwise(F.coalesce(url, F.lit("")))
    )
    return F.coalesce(numeric, short_digest(seed, "al_"))


def comment_id(fb_id: Column, comment: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(fb_id, F.lit("")), F.nullif(comment, F.lit("")), short_digest(F.coalesce(url, F.lit("")), "alc_"))


def tweet_id(tweet: Column, fb_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(tweet, F.lit("")), F.nullif(fb_id, F.lit("")), status_id(url), short_digest(F.coalesce(url, F.lit("")), "tw_"))


def video_link(url: Column) -> Column:
    """An attribution link as the watch page that it wraps."""
    inner = param(url, "u")
    inner = F.when(inner.startswith("http"), inner).otherwise(F.concat(F.lit("https://youtube.com"), inner))
    wraps = (domain(url) == "youtube.com") & (path(url) == "/attribution_link")
    return F.when(wraps & param(inner, "v").isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), param(inner, "v"))).otherwise(url)


# Hosts of watch pages, and of short links.
WATCH_HOSTS, SHORT_HOST = ("youtube.com", "youtube-nocookie.com"), "youtu.be"


def video_id(url: Column) -> Column:
    """The id of a video by watch page, attribution link or short link, else an empty text."""

    def found(inner: Column) -> Column:
        watched, short = F.coalesce(param(inner, "v"), F.lit("")), F.regexp_replace(loose_path(inner), "^/+", "")
        return let(site(inner), lambda host: F.when(host.isin(*WATCH_HOSTS), watched).when(host == SHORT_HOST, short).otherwise(""))

    return let(video_link(url), found)


def unwrapped(url: Column) -> Column:
    """The target of a proxy link, by its parameter url or utld."""
    return F.coalesce(param(url, "url"), param(url, "utld"), url)


def media_type(url: Column) -> Column:
    """1 image, 2 video, 3 animation."""
    low = F.lower(url)
    return F.when(low.contains("video.twimg.com/") | low.contains(".mp4") | low.contains(".m3u8"), 2).when(low.contains(".gif") | low.contains("tweet_video"), 3).otherwise(1)


def file_media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("mp4", "mov", "avi", "webm"), 2).when(ext == "gif", 3).otherwise(1)


def is_audio_stream(url: Column) -> Column:
    """A video variant without pictures, as its base64 parameter efg tells."""
    code = F.translate(param(url, "efg"), "-_", "+/")
    code = F.regexp_replace(code, "=+$", "")
    pad = F.when(F.length(code) % 4 == 2, "==").when(F.length(code) % 4 == 3, "=").otherwise("")
    plain = F.try_to_binary(F.concat(code, pad), F.lit("base64")).cast("string")
    return F.coalesce(F.contains(F.lower(F.get_json_object(plain, "$.vencode_tag")), F.lit("audio")), F.lit(False))


def media_path(name: Column, created: Column) -> Column:
    return F.concat(F.lit("media/"), F.coalesce(F.date_format(created, "yyyy/MM"), F.lit("unknown")), F.lit("/"), F.when(F.length(name) > 120, F.concat(F.substring(F.sha2(name, 256), 1, 16), F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))).otherwise(name))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 120)
