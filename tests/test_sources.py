import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import activity, archives, binpb, embeddings, graph, json_archive, schema, takeout, trees, tweets, web_archive

UTC = "yyyy-MM-dd HH:mm:ss"


def by_id(df):
    return {r.source_id: r for r in df.withColumn("created", F.date_format("created_at", UTC)).collect()}


def put(folder, **files):
    for name, content in files.items():
        path = folder / name.replace("__", "/").replace("_JSON", ".json")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(folder)


def zipped(folder, target):
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(folder.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(folder))
    return str(target)


def latin(s):
    return s.encode().decode("latin-1")


@pytest.fixture
def fb(tmp_path):
    folder = tmp_path / "fb"
    posts = [
        {"timestamp": 1000, "title": "Me updated", "data": [{"post": latin("Привет #мир @[12:3:Ann Lee]")}, {"update_timestamp": 2000}], "tags": [{"name": "Ann"}]},
        {"timestamp": 1000, "title": "Me shared a memory.", "data": [{"post": "gone"}]},
        {"timestamp": 1000, "data": [], "attachments": []},
        {"timestamp": 1000, "data": [{"post": "third"}]},
        {"timestamp": 5000, "data": [], "attachments": [{"data": [{"media": {"uri": "photos/a.GIF", "title": "t", "description": ""}}, {"external_context": {"url": "https://x.example"}}, {"place": {"name": "Here", "coordinate": {"latitude": 1.5}}}]}]},
        {"timestamp": 6000, "title": "Me commented on Y's post.", "data": [{"post": "no"}]},
    ]
    said = [
        {"timestamp": 1500, "title": "Me commented on his own post.", "data": [{"comment": {"comment": "direct", "author": "Me"}}]},
        {"timestamp": 1600, "title": "Me replied to his own comment.", "data": [{"comment": {"comment": "inside", "author": "Me"}}]},
        {"timestamp": 1700, "title": "Me commented on Y's post.", "data": [{"comment": {"comment": "out", "author": "Me"}}]},
        {"timestamp": 1800, "title": "Me replied to his own comment.", "data": [{"comment": {"comment": "outside", "author": "Me"}}]},
        {"timestamp": 900, "title": "Me commented on his own photo.", "data": [{"comment": {"comment": "too early", "author": "Me"}}]},
    ]
    put(folder, posts__your_posts__check_ins__photos_and_videos_1_JSON="")
    target = folder / "posts" / "your_posts__check_ins__photos_and_videos_1.json"
    for p in folder.rglob("*"):
        if p.is_file():
            p.unlink()
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(posts))
    (folder / "comments_and_reactions").mkdir()
    (folder / "comments_and_reactions" / "comments.json").write_text(json.dumps({"comments_v2": said}))
    return folder


@pytest.mark.parametrize("kind", ["folder", "zip"])
def test_json_archive(spark, fb, tmp_path, kind):
    path = str(fb) if kind == "folder" else zipped(fb, tmp_path / "fb.zip")
    got = by_id(json_archive.read(spark, path))
    assert set(got) == {"1000", "1000_3", "5000"}  # the empty post has taken _2
    first = got["1000"]
    assert first.content_text == "Привет #мир @Ann Lee" and first.tags == ["Ann", "мир"] and first.visibility == schema.PUBLIC
    assert [m.type for m in got["5000"].media] == [schema.GIF, schema.LINK] and got["5000"].location.lat == 1.5 and got["5000"].location.lng == 0.0
    # several posts at one time: the last in order
    assert [c.text for c in got["1000_3"].comments] == ["direct", "inside"]


@pytest.fixture
def log(tmp_path):
    stamp = lambda **kw: {"utime": None, "iso": None, "rawText": None} | kw
    posts = [
        {"url": "https://f.example/me/posts/11?__tn__=R", "text": "updated his status.Short #TagPublic3:21 AMView", "timestamp": stamp(utime=1_700_000_000_000)},
        {"url": "https://f.example/me/posts/11", "text": "updated his status.Short #Tag, longer Public3:21 AMView", "timestamp": stamp(utime=1_700_000_000)},
        {"url": "https://f.example/me/posts/pfbidX", "text": "shared a post.Common", "timestamp": stamp(rawText="January 5, 2024"), "reshareCommentary": "my wordsPublic9:16 AM"},
        {"url": "https://f.example/you/posts/12", "text": "shared a post.Common", "timestamp": stamp(utime=5)},
        {"url": "https://f.example/me/posts/13?ref=notif", "text": "UnreadX liked", "timestamp": stamp()},
        {"url": "https://f.example/she/posts/14", "text": "shared a photo.Alone", "timestamp": stamp(iso="2024-01-01T00:00:00Z")},
        {"url": "https://f.example/me/reel/15", "text": "added a video.Clip", "timestamp": stamp(utime=7)},
    ]
    said = [
        {"commentId": "c1", "url": "https://f.example/me/posts/11?comment_id=1", "timestamp": stamp(utime=9), "text": "commented on it.Yes"},
        {"commentId": "c2", "replyCommentId": "r", "fbId": "77", "url": "https://f.example/me/posts/11?comment_id=1&reply_comment_id=2", "timestamp": stamp(utime=8), "text": "First"},
        {"commentId": "c3", "url": "https://f.example/other/posts/99?comment_id=1", "timestamp": stamp(utime=8), "text": "Elsewhere"},
    ]
    video = "https://v.example/o1/v/t2/f2/m{}/x{}.mp4"
    media = [
        {"filename": "a.jpg", "originalUrl": "https://v.example/v/t39.30808-6/a.jpg", "sourcePermalink": "https://f.example/me/posts/11", "context": ""},
        {"filename": "t.jpg", "originalUrl": "https://v.example/v/t51.1/t.jpg", "sourcePermalink": "https://f.example/me/posts/11", "context": ""},
        {"filename": "skip.jpg", "originalUrl": "https://v.example/b.jpg", "sourcePermalink": "https://f.example/me/posts/11", "context": "", "skipped": True},
        *[{"filename": f"{k}.mp4", "originalUrl": video.format(k, k), "sourcePermalink": "https://f.example/me/reel/15", "context": ""} for k in (1, 2)],
        {"filename": "p.jpg", "originalUrl": "https://v.example/p.jpg", "sourcePermalink": "https://f.example/me/reel/15", "context": ""},
    ]
    folder = tmp_path / "log"
    put(folder, posts_JSON={"collectedAt": "2024-03-10T15:30:00Z", "postsWithText": posts}, comments_JSON={"collectedAt": "2024-03-10T15:30:00Z", "commentsWithText": said}, media_manifest_JSON=media, reaction_counts_JSON={"https://f.example/me/posts/11": 4}, link_attachments_JSON={"https://f.example/me/posts/11": [{"url": "u", "title": "t", "image": "i"}]}, profile_links_JSON={"Ann": "https://f.example/ann"})
    return str(folder)


def test_activity(spark, log):
    got = by_id(activity.read(spark, log))
    post = got["11"]
    assert post.content_text == "Short #Tag, longer" and post.tags == ["tag"] and post.created == "2023-11-14 22:13:20"
    assert [c.text for c in post.comments] == ["First", "Yes"] and [c.source_id for c in post.comments] == ["77", "c1"] and post.comments[0].parent_comment_id == "c2"
    assert post.extra == {"fb_reaction_total_count": "4"} and [m.original_filename for m in post.media] == ["a.jpg"]
    pair = next(r for r in got.values() if r.reshared_from and r.reshared_from.url.endswith("/you/posts/12"))
    assert pair.content_text == "" and pair.reshared_from.content_text == "Common" and pair.created == "2024-01-05 12:00:00"
    assert got["14"].source_url == "" and got["14"].reshared_from.author == "she" and "12" not in got and "13" not in got
    assert [m.original_filename for m in got["15"].media] == ["2.mp4"]
    assert len(got) == 4
    assert [tuple(r) for r in activity.profile_names(spark, log).collect()] == [("Ann", "https://f.example/ann")]
    assert activity.summary(activity.exported(spark, log, "*posts.json", activity.POSTS, "postsWithText", "p")).first() == (7, 1, 0, 3)


def test_merge_months(spark):
    df = spark.createDataFrame([("a", 1, "old", 2, False), ("a", 2, "new", 3, True), ("b", 1, "x", 1, False)], "k string, month int, text string, n int, early boolean")
    assert {tuple(r) for r in activity.merge_months(df, "k").select("k", "text", "n", "early").collect()} == {("a", "new", 5, True), ("b", "x", 1, False)}


def test_tweets(spark, tmp_path):
    base = {"author": "Me", "authorHandle": "@Me", "timestamp": {"iso": "2024-01-05T10:00:00.000Z"}}
    posts = [
        {"tweetId": "1", "url": "https://x.com/me/status/1", "text": "one #A", "likeCount": 3, **base},
        {"url": "https://x.com/me/status/1", "text": "one #A longer", "likeCount": 3, **base},
        {"tweetId": "2", "text": "repost", "resharedFrom": {"author": "Y", "url": "u"}, **base},
        {"tweetId": "3", "text": "look", "quotedTweet": {"url": "https://x.com/you/status/9", "text": "said"}, **base},
        {"tweetId": "4", "text": "not mine", **base, "authorHandle": "you"},
    ]
    replies = [
        {"tweetId": "5", "text": "to you", "inReplyTo": {"screenName": "you"}, **base},
        {"tweetId": "6", "text": "to me", "inReplyTo": {"screenName": ""}, "replyToHandle": "@ME", **base},
        {"tweetId": "7", "text": "undated", "author": "Me", "authorHandle": "me", "timestamp": {"utime": 1_700_000_000_000}},
    ]
    path = put(tmp_path / "x", posts_JSON={"postsWithText": posts}, comments_JSON={"postsWithText": replies}, reaction_counts_JSON={"https://x.com/me/status/1": 8}, media_manifest_JSON=[{"filename": "a.mp4", "originalUrl": "https://video.twimg.com/a.gif.mp4", "sourcePermalink": "https://x.com/me/status/1"}], link_attachments_JSON={"https://x.com/me/status/1": [{"url": "u", "title": "t", "image": "i"}]})
    got = by_id(tweets.read(spark, path))
    assert set(got) == {"1", "3", "6", "7"}
    assert got["1"].content_text == "one #A longer" and got["1"].extra == {"tw_like_count": "8"} and got["1"].tags == ["a"]
    assert [(m.type, m.original_url) for m in got["1"].media] == [(schema.VIDEO, "https://video.twimg.com/a.gif.mp4"), (schema.LINK, "i")]
    assert tuple(got["3"].reshared_from) == ("@you", "https://x.com/you/status/9", "said") and got["7"].created == "2023-11-14 22:13:20"


def test_takeout(spark, tmp_path):
    html = """<html><body><a href="https://g.example/1">2018-03-04T05:06:07+0200</a><span>Updated: 2018-03-05 06:00:00</span>
    <div class="visibility">Shared with: Extended circles</div><div class="main-content">Hello<br>World #тег #тег <script>x</script></div>
    <a class="media-link" href="https://youtube.com/attribution_link?u=/watch%3Fv%3DQ"><span class="video-placeholder" title="Video"></span></a>
    <a class="media-link" href="x"><img src="Photo%20A.GIF" alt="Image"></a><div class="link-embed"><a href="https://l.example"></a><h3>Card</h3></div>
    <div class="plus-oners"><a href="/p">Ann</a></div>
    <div class="comments"><div class="comment"><a class="author" href="/b">Bob</a><span>2018-03-04 06:00:00+0000</span><p>Nice</div></div></body></html>"""
    put(tmp_path / "g", **{"20180304 - Hello.html": html, "20190101 - Bare.html": "<div class='reshare-attribution'>by <a href='/z'>Zoe</a></div><div>Their words</div>"})
    got = by_id(takeout.read(spark, str(tmp_path / "g")))
    one, bare = got["20180304 - Hello"], got["20190101 - Bare"]
    assert one.created == "2018-03-04 03:06:07" and one.visibility == schema.FRIENDS and one.content_text == "Hello World #тег #тег" and one.tags == ["тег"]
    assert [(m.type, m.original_url, m.original_filename, m.caption) for m in one.media] == [(2, "https://www.youtube.com/watch?v=Q", "", ""), (3, "", "Photo A.GIF", ""), (4, "https://l.example", "", "Card")]
    assert one.reactions[0].user == "Ann" and (one.comments[0].author, one.comments[0].text) == ("Bob", "Nice")
    assert bare.created == "2019-01-01 00:00:00" and bare.reshared_from.author == "Zoe" and bare.content_text == "Their words"


def test_web_archive(spark):
    old = """<div class="tweet" data-tweet-id="50" data-screen-name="you"></div><div class="tweet permalink" data-tweet-id="100" data-screen-name="me" data-is-reply-to="true">
    <p class="tweet-text">Old <b>text</b></p><a class="tweet-timestamp"><span data-time="1500000000"></span></a></div><div class="tweet" data-tweet-id="200" data-screen-name="x"></div>"""
    new = """<article data-testid="tweet"><a href="/a/status/1"></a></article><article data-testid="tweet"><a href="/me"></a><a href="/me/status/300"><time datetime="2020-01-02T03:04:05.000Z"></time></a>
    <div data-testid="tweetText">New</div><div data-testid="tweetText">quoted</div><a href="/q/status/7"></a><img src="https://pbs.example/media/i.jpg"></article>"""
    snapshots = [(0, "20170101000000", "twitter.com/me/status/100"), (1, "20180101000000", "https://twitter.com/me/status/100"), (2, "20200101000000", "https://twitter.com/me/status/300"), (3, "20150101000000", "https://twitter.com/me/status/400"), (4, "2", "https://twitter.com/me")]
    pages = [("100", old), ("300", new)]
    got = by_id(web_archive.records(spark.createDataFrame(snapshots, "seq int, timestamp string, url string"), spark.createDataFrame(pages, "status string, html string")))
    assert got["100"].content_text == "Old text" and got["100"].created == "2017-07-14 02:40:00" and tuple(got["100"].reshared_from)[:2] == ("you", "https://twitter.com/you/status/50") and got["100"].extra["reply_context"] == "true"
    assert got["300"].content_text == "New" and got["300"].created == "2020-01-02 03:04:05" and tuple(got["300"].reshared_from)[:2] == ("q", "https://twitter.com/q/status/7") and len(got["300"].media) == 1
    assert got["400"].content_text == "" and got["400"].created == "2015-01-01 00:00:00" and got["100"].extra["wayback_timestamp"] == "20180101000000"


def test_graph(spark, tmp_path):
    posts = [
        {"id": "1", "message": "Hi #A #A", "created_time": "2023-04-15T12:34:56+0000", "privacy": {"value": "EVERYONE"}, "permalink_url": "https://f.example/1", "reactions": {"data": [{"type": "LOVE", "name": "Z"}, {"type": "NEW"}], "summary": {"total_count": 5}}, "comments": {"data": [{"id": "c", "message": "m", "from": {"name": "n"}, "parent": {"id": "p"}}]},
         "attachments": {"data": [{"type": "album", "url": "a", "subattachments": {"data": [{"type": "photo", "media": {"image": {"src": "https://i/1"}}}, {"type": "photo", "media": {"image": {"src": "https://i/2"}}}]}}]}},
        {"id": "2", "message": "Words", "attachments": {"data": [{"type": "share", "url": "https://n.example", "title": "T", "description": "D"}]}},
        {"id": "3", "message": "Same  text", "attachments": {"data": [{"type": "share", "url": "u", "description": "Same text", "target": {"id": "9"}}]}},
        {"id": "4", "privacy": {"value": "SELF"}},
        {"id": "5", "story": "was here", "place": {"name": "P", "location": {"latitude": 2.0}}, "privacy": {"value": "SELF"}},
    ]
    (tmp_path / "page.json").write_text(json.dumps({"data": posts}))
    got = by_id(graph.records(graph.read_pages(spark, str(tmp_path / "page.json"))))
    assert set(got) == {"1", "2", "3", "5"}
    assert got["1"].created == "2023-04-15 12:34:56" and got["1"].tags == ["A", "A"] and [m.original_url for m in got["1"].media] == ["https://i/1", "https://i/2"]
    assert [r.type for r in got["1"].reactions] == [5, 4] and got["1"].comments[0].parent_comment_id == "p" and got["1"].extra == {"fb_reaction_total_count": "5"} and got["1"].visibility == 1
    assert got["2"].reshared_from.content_text == "T\n\nD" and got["2"].visibility == 2 and got["3"].reshared_from is None and got["5"].visibility == 3 and got["5"].location.lng == 0.0
    edge = spark.createDataFrame([("2", 0, ("a", "", "late", None, "e", ""))], "post string, seq int, comment struct<author:string,author_url:string,text:string,date:timestamp,source_id:string,parent_comment_id:string>")
    more = by_id(graph.with_edge_comments(graph.records(graph.read_pages(spark, str(tmp_path / "page.json"))), edge))
    assert [c.text for c in more["2"].comments] == ["late"] and len(more["1"].comments) == 1


def test_edge_comments_of_posts_without_any(spark, tmp_path):
    """2 is said to have none, 3 doesn't say, and 4 has more than it shows."""
    posts = [{"id": i, "message": "m", "comments": c} for i, c in (("2", {"data": [], "summary": {"total_count": 0}}), ("3", None), ("4", {"data": [], "summary": {"total_count": 7}}))]
    (tmp_path / "page.json").write_text(json.dumps({"data": posts}))
    pages = graph.read_pages(spark, str(tmp_path / "page.json"))
    edge = spark.createDataFrame([(i, 0, ("a", "", "late", None, "e", "")) for i in "234"], "post string, seq int, comment struct<author:string,author_url:string,text:string,date:timestamp,source_id:string,parent_comment_id:string>")
    got = by_id(graph.with_edge_comments(graph.records(pages), edge, graph.told_empty(pages)))
    assert {i: len(r.comments) for i, r in got.items()} == {"2": 0, "3": 1, "4": 1}


def test_binpb_files(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit("text é "), F.col("id").cast("string")).alias("t"))
    records = schema.record(rows, source=F.lit(2), source_id=F.col("id").cast("string"), content_text=F.col("t"), created_at=F.timestamp_micros(F.col("id") * 1_000_001), extra=F.create_map(F.lit("k"), F.col("t")), tags=F.array("t"), location=F.when(F.col("id") % 2 == 0, F.struct(F.lit("n").alias("name"), F.lit(1.5).alias("lat"), F.lit(0.0).alias("lng"))))
    binpb.write(records, str(tmp_path / "w"))
    binpb.export(str(tmp_path / "w"), str(tmp_path / "files"))
    (tmp_path / "files" / "bad.binpb").write_bytes(b"\x00\x00\x00\x05ab")
    got = binpb.read(spark, str(tmp_path / "files"))
    assert got.where("error is not null").count() == 1
    back = got.where("error is null").drop("file", "error")
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))


def test_zip_without_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("other.txt", "x")
    assert archives.members(spark, str(tmp_path / "e.zip"), "*posts.json").count() == 0


def test_trees():
    text = '{"a": {"post_id": "7", "creation_time": 5, "x": [{"uri": "https://i/1"}]}}\nnot json\n{"story_fbid": "8", "publish_time": 6, "attached": {"playable_url": "https://v/2"}}'
    assert trees.times_of(text) == [{"post": "7", "at": 5}, {"post": "8", "at": 6}]
    assert trees.media_of(text) == [{"post": "7", "url": "https://i/1"}, {"post": "8", "url": "https://v/2"}]
    assert trees.times_of(None) == []


def test_ids_and_times_of_stories():
    """All ids and the URL of a node, times as numbers, texts and in milliseconds; `id` alone names no story, no time no row."""
    text = """[{"post_id": 1, "story_id": " s ", "url": "https://www.facebook.com/a/1", "id": "n", "creation_time": "1600000000"}, {"__typename": "Story", "id": "4", "created_time": "2020-05-06T07:08:09+0200"},
      {"id": "5", "creation_time": 9}, {"post_id": "6", "publishTime": 1600000000123}, {"post_id": "7", "creation_time": "soon"}, {"post_id": "1", "publish_time": 5}, {"post_id": "8", "x": {"creation_time": 3}}]"""
    at = 1_600_000_000
    assert {r["post"]: r["at"] for r in trees.times_of(text)} == {"1": at, "s": at, "n": at, "https://www.facebook.com/a/1": at, "4": 1_588_741_689, "6": at}


def test_relations_of_messages(spark):
    user = '{"core": {"user_results": {"result": {"legacy": {"screen_name": "ann", "name": "Ann"}}}}, "legacy": {"full_text": "so"}}'
    text = f"""{{"a": [{{"rest_id": "1", "legacy": {{"quoted_status_id_str": "9"}}, "quoted_status_result": {{"result": {user}}}}}, {{"rest_id": "2", "legacy": {{}}}},
      {{"rest_id": "3", "legacy": {{"quoted_status_id_str": "8", "quoted_status_permalink": {{"expanded": "https://twitter.com/bob/status/8"}}, "in_reply_to_status_id_str": "7", "in_reply_to_screen_name": "cy"}}}}]}}"""
    rows = spark.createDataFrame([(text,), (None,), ("not json",)], "t string").select(F.explode(trees.relations("t")).alias("r")).select("r.*").collect()
    first, second = sorted(rows, key=lambda r: r.id)
    assert first.asDict() == {"id": "1", "quoted_id": "9", "quoted_url": "https://x.com/ann/status/9", "quoted_handle": "ann", "quoted_author": "Ann", "quoted_text": "so", "reply_to": None, "reply_handle": None, "reply_user": None}
    assert (second.id, second.quoted_handle, second.quoted_text, second.reply_to, second.reply_handle) == ("3", "bob", None, "7", "cy")


@pytest.mark.parametrize(
    "above, parent",
    [([("5", "a"), ("8", "b"), ("12", "c")], ("b", "8")), ([("12", "c"), ("11", "r")], ("r", "11")), ([("12", "c"), ("13", "d")], ("d", "13")), ([("4", "")], ("", "4")), ([], ("no", "9"))],
)
def test_parent_of_an_archived_message(above, parent):
    """The latest older ancestor, else the conversation's first, else the last; an older message that is none only if none is marked."""
    tweet = '<div class="tweet {}" data-tweet-id="{}" data-screen-name="{}" data-is-reply-to="true" data-conversation-id="11"><p class="tweet-text">t</p></div>'
    page = "".join(tweet.format("ancestor", *a) for a in above) + tweet.format("main", 10, "me") + tweet.format("other", 9, "no")
    got = web_archive.message(page, "10")
    assert (got["reply_author"], got["reply_url"]) == (parent[0], f"https://twitter.com/{parent[0] or 'i'}/status/{parent[1]}")


def test_embeddings(spark):
    def call(texts):
        return {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(texts)))]}

    df = spark.createDataFrame([(k, "x" * k) for k in range(10)], "id long, text string")
    assert {r.id: r.embedding[0] for r in embeddings.embed(df, call, 4).collect()} == {k: float(k) for k in range(1, 10)}
    with pytest.raises(ValueError):
        embeddings.ordered({"data": []}, 1)


def test_serving_rows(spark):
    records = schema.record(spark.range(1), source=F.lit(2), source_id=F.lit("a"), visibility=F.lit(2), extra=F.create_map(F.lit("fb_comment_total_count"), F.lit("7"), F.lit("tw_like_count"), F.lit("bad")))
    row = schema.serving_rows(records, 3).first()
    assert (row.visibility, row.comment_count, row.reaction_count, row.content_text) == (2, 7, 0, "")


def test_sinks(spark, tmp_path):
    from lodestone.sources import sinks

    rows = spark.createDataFrame([(k, f"T<{k}>", "a & b", f"202{k % 3}-01-01 00:00:00" if k else None) for k in range(30)], "id long, title string, description string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    feed = sinks.feed(sinks.feed_items(rows, "https://b.example"), "Blog", "https://b.example")
    assert feed.count("<item>") == 20 and "T&lt;29&gt;" in feed and feed.index("/post/29/") < feed.index("/post/26/")
    sinks.write_sitemap(rows, str(tmp_path / "s"), "https://b.example", per_file=4)
    got = spark.read.text(str(tmp_path / "s"))
    assert got.count() == 29 and {r.year for r in got.select("year").distinct().collect()} == {2020, 2021, 2022}
    table = spark.createDataFrame([(1, "a"), (2, "b")], "source int, v string")
    sinks.write_snapshot(table, str(tmp_path / "t"))
    sinks.write_snapshot(table.where("source = 2").withColumn("v", F.lit("new")), str(tmp_path / "t"), "2")
    assert {(r.source, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "new")}
