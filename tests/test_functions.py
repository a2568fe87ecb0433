import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, urls
from lodestone.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("ÐŸÑ€Ð¸Ð²ÐµÑ‚".encode("cp1252", "ignore").decode("latin-1"), None), ("Привет".encode().decode("latin-1"), "Привет"), ("café", "café"), ("Привет", "Привет"), ("plain", "plain"), ("", "")])
def test_fix_encoding(spark, raw, want):
    got = one(spark, T.fix_encoding(F.col("c")), c=raw)
    assert want is None or got == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("shared a post.My wordsPublic3:21 AMView", "My words"),
        ("Updated his status. Текст поста Only me 13:05 View", "Текст поста"),
        ("UnreadSomeone liked it 5h Mark as read", "Someone liked it"),
        ("no action hereView", "no action here"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_activity(spark, raw, want):
    assert one(spark, T.clean_activity(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("shared a post.x", True), ("Shared a .", True), ("shared a link.x", False), ("shared an album.", False), ("added a photo.", False)])
def test_is_reshare(spark, raw, want):
    assert one(spark, T.is_reshare(F.col("c")), c=raw) is want


@pytest.mark.parametrize(("raw", "want"), [("Что ты думаешь о войне?", "ru"), ("What do you think?", "en"), ("Hi", "en"), ("Wie geht es dir heute", "other"), ("Où est-il", "other"), ("123 !?", "other"), ("да", "other"), ("", "other"), (None, "other")])
def test_language(spark, raw, want):
    assert one(spark, T.language(F.col("c")), c=raw) == want


def test_hashtags(spark):
    assert one(spark, T.hashtags(F.col("c")), c="#Тег and #été_1, #a#b") == ["Тег", "été_1", "a", "b"]
    assert one(spark, T.short_hashtags(F.col("c")), c="#Тег #A #a #é") == ["тег", "a", "a"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("X shared a memory.", "memory"), ("X shared a product.", "market"), ("X commented on his own post.", "self_direct"), ("X replied to her own comment.", "self_reply"), ("X replied to Y's comment.", "external"), ("X updated", "post"), (None, "post")],
)
def test_title_kind(spark, title, want):
    assert one(spark, T.title_kind(F.col("c")), c=title) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("что было 2022-02-24 и 2022-13-40?", ["2022-02-24"]),
        ("24.2.2022 или 24 февраля 2022 года", ["2022-02-24"]),
        ("on Feb 24, 2022 and March 3 2021", ["2022-02-24", "2021-03-03"]),
        ("5 мая 2020, 6 марта 2020", ["2020-05-05", "2020-03-06"]),
        ("о начале... начала войны", ["2022-02-24"]),
        ("2020-01-01 2020-01-02 2020-01-03 2020-01-04", ["2020-01-01", "2020-01-02", "2020-01-03"]),
        ("no date, 31.2.2020", []),
    ],
)
def test_mentioned(spark, question, want):
    assert [d.isoformat() for d in one(spark, dates.mentioned(F.col("c")), c=question)] == want


NOW = "2024-03-10T15:30:00.000Z"


def seconds(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("utime", "iso", "raw", "want"),
    [
        (1_700_000_000, None, None, 1_700_000_000),
        (1_700_000_000_123, None, "5:13 PM", 1_700_000_000),
        (1_700_000_000, None, "January 5, 2024", seconds(2024, 1, 5, 12)),
        (0, "2024-01-05T10:00:00+02:00", None, seconds(2024, 1, 5, 8)),
        (0, None, "just now", seconds(2024, 3, 10, 15, 30)),
        (0, None, "Today", seconds(2024, 3, 10, 12)),
        (0, None, "Yesterday at 5", seconds(2024, 3, 9, 15, 30)),
        (0, None, "3 hours ago", seconds(2024, 3, 10, 12, 30)),
        (0, None, "5 January 2024 at 9:36 PM", seconds(2024, 1, 5, 21, 36)),
        (0, None, "Feb 30, 2024", None),
        (0, None, "March 3 at 12:05 AM", seconds(2024, 3, 3, 0, 5)),
        (0, None, "December 15", seconds(2023, 12, 15, 12)),
        (0, None, "??", None),
        (0, None, None, None),
    ],
)
def test_resolve(spark, utime, iso, raw, want):
    assert one(spark, dates.resolve(F.col("u"), F.col("i"), F.col("r"), F.lit(NOW)), u=utime, i=iso, r=raw) == want


def test_months_back(spark):
    assert [d.isoformat() for d in one(spark, dates.months_back(F.lit("2023-11-20").cast("date"), F.lit("2024-01-03").cast("date")), c="")] == ["2024-01-01", "2023-12-01", "2023-11-01"]
    assert one(spark, dates.months_back(F.lit("2024-11-20").cast("date"), F.lit("2024-01-03").cast("date")), c="") == []


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://f.example/u/posts/pfbid0AbC?__cft__=1", "pfbid0AbC"),
        ("https://f.example/u/posts/123", "123"),
        ("https://f.example/p.php?story_fbid=pfbid7&id=1", "pfbid7"),
        ("https://f.example/photo?fbid=44&set=a.1", "44"),
        ("https://f.example/reel/55/", "55"),
        ("https://f.example/about", None),
        ("", None),
        (None, None),
    ],
)
def test_post_id(spark, url, want):
    assert one(spark, urls.post_id(F.col("c")), c=url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://f.example/p?id=1&comment_id=2&reply_comment_id=3#x", "https://f.example/p?id=1"),
        ("https://f.example/p?comment_id=2", "https://f.example/p"),
        ("https://f.example/p?a=b%20c&a=d&__tn__=R&e", "https://f.example/p?a=b+c&e="),
        ("https://f.example/p", "https://f.example/p"),
    ],
)
def test_post_key(spark, url, want):
    assert one(spark, urls.post_key(F.col("c")), c=url) == want


def test_video_link(spark):
    assert one(spark, urls.video_link(F.col("c")), c="https://youtube.com/attribution_link?a=1&u=/watch%3Fv%3DAbC%26x%3D1") == "https://www.youtube.com/watch?v=AbC"
    assert one(spark, urls.video_link(F.col("c")), c="https://example.org/x") == "https://example.org/x"


def test_audio_stream(spark):
    import base64
    import json

    code = lambda tag: base64.urlsafe_b64encode(json.dumps({"vencode_tag": tag}).encode()).decode().rstrip("=")
    for tag, want in (("dash_ln_heaac_vbr3_audio", True), ("dash_h264", False)):
        assert one(spark, urls.is_audio_stream(F.col("c")), c=f"https://v.example/o1/v/t2/f2/m69/a.mp4?efg={code(tag)}") is want
    assert one(spark, urls.is_audio_stream(F.col("c")), c="https://v.example/a.mp4?efg=%%%") is False


def test_slug_and_names(spark):
    assert one(spark, T.slug(F.col("c")), c="Été à la Mer, 2024!") == "ete-a-la-mer-2024"
    for slug, name in {"jane.roe.42": "Jane Roe", "MusterMarta": "Muster Marta", "mike99": "Mike99", "max.lang.9": "Max Lang", "42.7": "42.7", "max.musterMann12": "Max Mustermann12", "o'neil": "O'Neil", "": ""}.items():
        assert one(spark, T.humanise(F.col("c")), c=slug) == name
    assert one(spark, T.question_key(F.col("c")), c="  What\n IS ") == one(spark, T.question_key(F.col("c")), c="what is")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.facebook.com/me/posts/pfbid0", True),
        ("https://m.facebook.com/story.php?story_fbid=1&id=2", True),
        ("https://www.facebook.com/photo/?fbid=1", True),
        ("https://www.facebook.com/reel/123/?s=tab", True),
        ("https://www.facebook.com/reel/?s=tab", False),
        ("https://www.facebook.com/x?fbid=1", False),
        ("https://www.facebook.com/groups/1/permalink/2", False),
        ("https://l.facebook.com/posts/1", False),
        ("https://f.example/posts/1", False),
        (None, False),
    ],
)
def test_content_urls(spark, url, want):
    from lodestone.functions import rules

    assert one(spark, rules.is_content(F.col("c")), c=url) is want


def test_embeds(spark):
    from lodestone.functions import rules

    for url, want in {"https://x.com/a/status/12/#x": "https://twitter.com/a/status/12", "http://www.twitter.com/A_b/statuses/7?s=1": "https://twitter.com/A_b/status/7", "https://mobile.twitter.com/a/status/1": "", "https://x.com/a": "", None: ""}.items():
        assert one(spark, rules.tweet_embed(F.col("c")), c=url) == want
    play = "https://www.facebook.com/plugins/"
    assert one(spark, rules.video_embed(F.col("c")), c="https://www.facebook.com/a/videos/1/?x=a b") == f"{play}video.php?height=314&href=https%3A%2F%2Fwww.facebook.com%2Fa%2Fvideos%2F1%2F%3Fx%3Da%20b&show_text=false&width=560"
    assert one(spark, rules.post_embed(F.col("c")), c="https://fb.com/a/posts/1") == f"{play}post.php?height=600&href=https%3A%2F%2Ffb.com%2Fa%2Fposts%2F1&show_text=true&width=500"
    assert one(spark, rules.video_embed(F.col("c")), c="https://f.example/reel/1") == "" == one(spark, rules.post_embed(F.col("c")), c="https://f.example/x")
    for source, theirs, own, want in [(4, "", "u", True), (3, "", "u", False), (3, "u", None, True), (3, "https://facebook.com/a/1/", "https://www.facebook.com/a/1#x", False), (3, "https://facebook.com/a/1", "https://facebook.com/A/2", False), (3, "https://facebook.com/b/1", "https://facebook.com/a/2", True)]:
        frame = spark.createDataFrame([(source, theirs, own)], "s int, t string, o string")
        assert frame.select(rules.shows_frame(F.col("s"), F.col("t"), F.col("o")).alias("x")).first().x is want


def test_video_ids(spark):
    for url, want in {"https://www.youtube.com/watch?a=1&v=AbC": "AbC", "https://youtu.be/AbC?t=1": "AbC", "https://youtube-nocookie.com/x?v=1": "1", "https://youtube.com/attribution_link?u=/watch%3Fv%3DAbC": "AbC", "https://m.youtube.com/watch?v=1": "", "https://youtube.com/embed/1": "", None: ""}.items():
        assert one(spark, urls.video_id(F.col("c")), c=url) == want
