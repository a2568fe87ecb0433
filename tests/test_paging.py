"""Chains of saved pages against a plain walk, the rules for errors, and the source that follows cursors."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from lodestone.sources import graph, paging

API = "https://graph.example/v1"
NO_EDGE = {"error": {"message": "not here", "code": 200, "error_subcode": paging.NO_POSTS_EDGE}}


def saved(spark, bodies):
    rows = [(u, b if isinstance(b, str) else json.dumps(b)) for u, b in bodies.items()]
    return paging.pages(spark.createDataFrame(rows, "url string, body string"))


def ids(spark, bodies, key="me"):
    starts = spark.createDataFrame([(key, f"{API}/me/posts", f"{API}/me?fields=feed")], "key string, posts_url string, feed_url string")
    rows = paging.posts(saved(spark, bodies), starts).orderBy("place", "pos").collect()
    return [json.loads(r.item)["id"] for r in rows]


def page(*names, after=None):
    return {"data": [{"id": n} for n in names], "paging": {"next": after} if after else {}}


def test_one_page(spark):
    assert ids(spark, {f"{API}/me/posts": page("p1", "p2")}) == ["p1", "p2"]
    assert ids(spark, {f"{API}/me/posts": {"data": [{"id": "only"}]}}) == ["only"]


def test_next_is_followed_without_its_token(spark):
    bodies = {f"{API}/me/posts": page("p1", after=f"{API}/me/posts?after=c1&access_token=tok"), f"{API}/me/posts?after=c1": page("p2", after=f"{API}/me/posts?access_token=tok&after=c2"), f"{API}/me/posts?after=c2": page("p3")}
    assert ids(spark, bodies) == ["p1", "p2", "p3"]


def test_feed_where_there_is_no_edge(spark):
    assert ids(spark, {f"{API}/me/posts": NO_EDGE, f"{API}/me?fields=feed": {"feed": page("f1", "f2"), "id": "user1"}}) == ["f1", "f2"]


def test_feed_ends_where_its_next_page_has_no_edge(spark):
    first = {"feed": page("a", after=f"{API}/uid/feed?access_token=tok"), "id": "user1"}
    assert ids(spark, {f"{API}/me/posts": NO_EDGE, f"{API}/me?fields=feed": first, f"{API}/uid/feed": NO_EDGE}) == ["a"]


@pytest.mark.parametrize("bodies", [
    {f"{API}/me/posts": {"error": {"message": "limit", "error_subcode": 1}}},
    {f"{API}/me/posts": NO_EDGE, f"{API}/me?fields=feed": NO_EDGE},
    {f"{API}/me/posts": page("p", after="x"), "x": NO_EDGE},
    {f"{API}/me/posts": NO_EDGE, f"{API}/me?fields=feed": {"feed": page("p", after="x")}, "x": {"error": {"message": "limit"}}},
    {f"{API}/me/posts": "<html>"},
])
def test_other_errors_raise(spark, bodies):
    with pytest.raises(PySparkException, match="of a chain"):
        ids(spark, bodies)


def test_pages_outside_of_chains_may_fail(spark):
    assert ids(spark, {f"{API}/me/posts": page("p"), f"{API}/other": {"error": {"message": "limit"}}, f"{API}/more": "<html>"}) == ["p"]


def test_missing_pages_and_circles(spark):
    bodies = {f"{API}/me/posts": page("p1", after="x"), "x": page("p2", after="y"), "y": page("p3", after="x")}
    assert ids(spark, bodies) == ["p1", "p2", "p3"]
    pages = saved(spark, {f"{API}/me/posts": page("p1", after="x"), "x": page(after="z")})
    chain = paging.chained(pages.select("url", "next"), spark.createDataFrame([("me", f"{API}/me/posts")], "key string, url string"))
    assert [(r.key, r.url) for r in paging.missing(pages, chain).collect()] == [("me", "z")]


def test_chains_of_all_lengths(spark):
    r = random.Random(6)
    links, starts, want = [], [], set()
    for key, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 40]):
        names = [f"{key}/{r.random()}" for _ in range(n)]
        links += list(zip(names, names[1:])) + [(names[-1], None)]
        starts.append((key, names[0]))
        want |= {(key, u, k) for k, u in enumerate(names)}
    r.shuffle(links)
    links.append(("into", starts[3][1]))  # a chain may join another one
    starts.append((99, "into"))
    want |= {(99, "into", 0)} | {(99, u, k + 1) for key, u, k in want if key == 3}
    got = paging.chained(spark.createDataFrame(links, "url string, next string"), spark.createDataFrame(starts, "key int, url string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not paging.chained(spark.createDataFrame([], "url string, next string"), spark.createDataFrame([], "key int, url string")).count()


def said(*names, after=None):
    return {"data": [{"id": n, "message": n.upper(), "from": {"name": "A"}, "created_time": "2023-01-01T00:00:00+0000"} for n in names], "paging": {"next": after} if after else {}}


def comments(spark, post, bodies):
    found = spark.createDataFrame([("me", json.dumps(post))], "key string, item string")
    rows = paging.comments(saved(spark, bodies | {"unused": {}}), found)
    p = paging.with_comments(found, rows)
    out = [[c.text for c in r.comments] for r in graph.records(p).collect()]
    assert [len(json.loads(c) and c) > 0 for r in rows.collect() for c in r.comments] == [True] * sum(map(len, out))
    return out[0]


POST = {"id": "p1", "message": "hi", "created_time": "2023-01-01T00:00:00+0000", "privacy": {"value": "EVERYONE"}}


def test_comments_of_the_second_page(spark):
    assert comments(spark, POST | {"comments": said("a", after=f"{API}/cnext?access_token=xx")}, {f"{API}/cnext": said("b")}) == ["A", "B"]


def test_comments_of_the_edge(spark):
    edge = {"p1/comments": said("e1", after="e2"), "e2": said("e3")}
    assert comments(spark, POST | {"comments": {"data": []}}, edge) == ["E1", "E3"]
    assert comments(spark, POST, edge) == ["E1", "E3"]
    assert comments(spark, POST | {"comments": {"data": [], "summary": {"total_count": 0}}}, edge) == []
    assert comments(spark, POST | {"comments": {"data": [], "summary": {"total_count": 5}}}, edge) == ["E1", "E3"]
    assert comments(spark, POST | {"comments": said("own")}, edge) == ["OWN"]


def test_an_edge_that_fails_gives_nothing(spark):
    assert comments(spark, POST, {"p1/comments": said("e1", after="e2"), "e2": {"error": {"message": "gone"}}}) == []
    assert comments(spark, POST, {}) == []


def test_pages_of_the_posts_own_comments_may_not_fail(spark):
    with pytest.raises(PySparkException, match="of a chain"):
        comments(spark, POST | {"comments": said("a", after="x")}, {"x": {"error": {"message": "gone"}}})


def test_saved_responses(spark, tmp_path):
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps({"url": u, "body": json.dumps(b)}) for u, b in {"a": page("p"), "b": page()}.items()) + "\nnot json\n")
    assert sorted(r.url for r in paging.read_responses(spark, str(tmp_path)).collect()) == ["a", "b"]


BODIES = {
    "one": page("1", after="one2"), "one2": page("2", after="one3"), "one3": page("3"),
    "two": NO_EDGE, "two-feed": {"feed": page("4", after="two3")}, "two3": NO_EDGE, "none": {"error": {"message": "no"}},
}


def fetch(options):
    return lambda url: json.dumps(BODIES[url])


PROFILES = json.dumps([["one", "one-feed"], ["two", "two-feed"], ["none", "x"]])


def test_source_follows_cursors(spark, tmp_path):
    spark.dataSource.register(paging.GraphPages)
    reader = spark.read.format("graph_pages").option("profiles", PROFILES).option("fetch", "tests.test_paging:fetch").load()
    assert reader.rdd.getNumPartitions() == 3
    rows = reader.collect()
    assert sorted(r.url for r in rows) == sorted(BODIES)
    saved_ = paging.pages(reader)
    starts = spark.createDataFrame([("1", "one", "one-feed"), ("2", "two", "two-feed")], "key string, posts_url string, feed_url string")
    found = paging.posts(saved_, starts).orderBy("key", "place", "pos").collect()
    assert [(r.key, json.loads(r.item)["id"]) for r in found] == [("1", "1"), ("1", "2"), ("1", "3"), ("2", "4")]


def test_stream_keeps_its_cursors():
    stream = paging.GraphStream({"profiles": PROFILES, "fetch": "tests.test_paging:fetch"})
    offset, met = stream.initialOffset(), []
    while offset["open"]:
        again = [u for u, _ in stream.readBetweenOffsets(offset, None)]
        rows, offset = stream.read(json.loads(json.dumps(offset)))
        met.append([u for u, _ in rows])
        assert met[-1] == again
    assert met == [["one", "two", "none"], ["one2", "two-feed"], ["one3", "two3"]]
