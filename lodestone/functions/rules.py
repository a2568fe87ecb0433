"""Rules by which captured URLs and rows are kept or dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.text import let

# What the URL of a post has, what that of another page has, and parts beside which a bare fbid is a post's. All in lower case.
SITE = "facebook.com"
POST_PARTS = r"/posts/|pfbid|story_fbid|permalink|/reel/|fbid=|/photo|comment_id=|/videos/"
OTHER_PARTS = r"/allactivity|facebook\.com/settings|/profile\.php|/groups/|/events/|/messages/|/marketplace/|/pages/|/about|l\.facebook\.com"
FBID, FBID_OF_POST = "fbid=", r"/posts/|/photo|/reel/|/videos/|story_fbid|pfbid|comment_id="
REEL_TAB, TAB, REEL = r"/reel/\?", r"[?&]s=tab\b", r"/reel/\d+"
# Images of the short-message network that belong to the site or to a profile, and those of posts. All in lower case.
SITE_IMAGES = r"pbs\.twimg\.com/profile_images/|pbs\.twimg\.com/profile_banners/|/emoji/|abs\.twimg\.com/"
POST_IMAGES = r"pbs\.twimg\.com/(?:media|tweet_video_thumb|ext_tw_video_thumb|amplify_video_thumb|card_img)/|video\.twimg\.com/"
# Endings of images, and hosts that shorten links.
IMAGE = r"(?i)\.(jpe?g|png|gif|webp|bmp)(\?.*)?$"
SHORTENERS = ("goo.gl", "bit.ly", "t.co", "ow.ly", "tinyurl.com", "is.gd", "buff.ly", "dlvr.it")
# The harvester's lists of foreign images and of hosts with images of posts, in lower case; t51 passes, unlike the importer's.
HARVEST_FOREIGN = r"/rsrc\.php/|static\.xx\.fbcdn\.net|/v/t15\.5256|/v/t39\.30808-1/|/v/t1\.6435-"
HARVEST_HOSTS = (("scontent", "fbcdn.net"), ("external.", "fbcdn.net"), ("external-", "fbcdn.net"), ("video.", "fbcdn.net"), ("video-", "fbcdn.net"), ("scontent", "cdninstagram.com"))
# Hosts whose posts and videos the network's players take.
PLAYER_HOSTS = ("facebook.com", "fb.com", "fb.watch", "m.facebook.com")
VIDEO_PATHS = r"/reel/|/watch|/videos/|video\.php"
FACEBOOK = 3


def is_content(url: Column) -> Column:
    """Whether a captured URL is that of a post, a photo, a video or a comment."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bare_id = low.contains(FBID) & ~low.rlike(FBID_OF_POST)
    tab = low.rlike(REEL_TAB) & low.rlike(TAB) & ~low.rlike(REEL)
    return low.contains(SITE) & ~low.rlike(OTHER_PARTS) & ~bare_id & ~tab & low.rlike(POST_PARTS)


def keeps_image(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return ~low.rlike(SITE_IMAGES) & low.rlike(POST_IMAGES)


def harvest_keeps_image(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    hosts = F.lit(False)
    for pair in HARVEST_HOSTS:
        hosts = hosts | (low.contains(pair[0]) & low.contains(pair[1]))
    return ~F.coalesce(url.contains("emoji"), F.lit(False)) & ~low.rlike(HARVEST_FOREIGN) & hosts


def on_own_profile(url: Column, own: Column) -> Column:
    return F.lower(F.regexp_extract(U.loose_path(url), "^/+([^/]+)", 1)) == F.lower(own)


def repeats_itself(key: Column, target: Column) -> Column:
    """A reshare whose target is the row itself, or a profile by number."""
    return (U.post_key(key) == U.post_key(target)) | target.contains("idorvanity=")


def is_shortened(url: Column) -> Column:
    return U.site(url).isin(*SHORTENERS)


def is_image(url: Column) -> Column:
    return url.rlike(IMAGE)


def replay_url(url: Column, stamp: Column) -> Column:
    """Where a web archive replays a URL at a time."""
    return F.concat(F.lit("https://web.archive.org/web/"), F.date_format(stamp, "yyyyMMddHHmmss"), F.lit("/"), url)


def reclassified(kind: Column, url: Column) -> Column:
    """Links to images as images."""
    return F.when((kind == 4) & is_image(url), 1).otherwise(kind)


def question_error(question: Column, most: int = 4000) -> Column:
    """Why a question isn't answered, or null."""
    text = F.trim(F.coalesce(question, F.lit("")))
    return F.when(text == "", "empty").when(F.length(text) > most, "too long")


def tweet_embed(url: Column) -> Column:
    """The URL under which a status can be embedded, empty for any other URL."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), "/+$", "")
    pattern = r"https?://(?:www\.)?(?:x\.com|twitter\.com)/([^/?]+)/status(?:es)?/(\d+)"
    found = F.concat(F.lit("https://twitter.com/"), F.regexp_extract(plain, pattern, 1), F.lit("/status/"), F.regexp_extract(plain, pattern, 2))
    return F.when(plain.rlike(pattern), found).otherwise("")


def _played(url: Column, player: str, height: int, text: str, width: int) -> Column:
    return F.concat(F.lit(f"https://www.facebook.com/plugins/{player}.php?height={height}&href="), U.percent(url), F.lit(f"&show_text={text}&width={width}"))


def video_embed(url: Column) -> Column:
    """A video or reel as the network's player takes it, empty for any other URL."""
    good = U.site(url).isin(*PLAYER_HOSTS) & F.lower(U.loose_path(url)).rlike(VIDEO_PATHS)
    return F.when(good, _played(url, "video", 314, "false", 560)).otherwise("")


def post_embed(url: Column) -> Column:
    """Any of the network's URLs as its player of posts takes it, empty for URLs of others."""
    return F.when(U.site(url).isin(*PLAYER_HOSTS, "l.facebook.com"), _played(url, "post", 600, "true", 500)).otherwise("")


def feed_item(url: Column) -> Column:
    """By what two URLs are the same item of a feed: host, path and query; www., m., the fragment and slashes at the path's end don't count."""
    path = F.regexp_replace(U.loose_path(url), "/+$", "")
    return F.concat(F.regexp_replace(U.site(url), r"^m\.", ""), F.when(path == "", "/").otherwise(path), F.lit("?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def shows_frame(source: Column, reshared_url: Column, source_url: Column) -> Column:
    """Whether a reshare can be shown in a frame: always on other networks; else it has a URL, which is neither the post's own nor of the same profile."""
    profile = lambda u: F.lower(F.split(F.regexp_replace(U.loose_path(u), "^/+|/+$", ""), "/")[0])

    def differ(urls: Column) -> Column:
        theirs, own = urls["theirs"], urls["own"]
        same = (theirs == own) | (feed_item(theirs) == feed_item(own))
        alike = let(F.struct(profile(theirs).alias("a"), profile(own).alias("b")), lambda p: (p["a"] != "") & (p["a"] == p["b"]))
        return F.when(theirs == "", False).when(own == "", True).otherwise(~same & ~alike)

    both = F.struct(F.trim(F.coalesce(reshared_url, F.lit(""))).alias("theirs"), F.trim(F.coalesce(source_url, F.lit(""))).alias("own"))
    return F.when(F.coalesce(source != FACEBOOK, F.lit(True)), True).otherwise(let(both, differ))


def safe_extension(url: Column) -> Column:
    ext = F.lower(F.regexp_extract(U.loose_path(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "gif", "webp", "mp4", "mov", "webm"), ext).otherwise("jpg")
