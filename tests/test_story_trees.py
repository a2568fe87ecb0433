"""Stories and media by walks over variants, against the walk in Python and by example."""

import json

import pytest

from lodestone.plans import responses
from lodestone.sources import story_trees, trees


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_times_equal_the_walk_in_python(spark, sf_dir):
    texts = responses.responses(spark, sf_dir)
    want = sorted((r.event_id, found["post"], found["at"]) for r in texts.collect() for found in trees.times_of(r.text))
    assert rows_of(story_trees.times(texts, "text", "event_id")) == want and want


@pytest.fixture(scope="module")
def texts(spark):
    deep = '{"token":"deep","creation_time":7,"image":{"uri":"http://d"}}'
    for _ in range(12):
        deep = f'[{{"a":{deep}}}]'
    pretty = json.dumps({"post_id": "p", "creation_time": 1600000000123, "hd_src": "http://v", "inner": {"sd_src": "http://w", "url": 3}}, indent=2)
    lines = 'not json\n{"fbid": 1, "publish_time": "1600000000", "large_image": {"uri": "ftp://x"}}\n\n{"fbid": "1", "publish_time": 5, "x": [{"image": {"uri": "http://i"}}, {"image": {"uri": "http://i"}}]}'
    rows = [(1, deep), (2, pretty), (3, lines), (4, None), (5, ""), (6, '"creation_time"'), (7, '{"token": "t", "creation_time": "soon"}'), (8, '{"token": "t", "creation_time": 1e300}'), (9, '{"token": "t", "created_time": "2020-05-06T07:08:09+0200"}'), (9, '{"token": "t", "created_time": "2020-05-06T07:08:09+0200"}')]
    return spark.createDataFrame(rows, "pos long, value string")  # names that the walk itself uses


def test_times_by_example(texts):
    got = rows_of(story_trees.times(texts, "value", "pos"))
    assert got == [(1, "deep", 7), (2, "p", 1_600_000_000), (3, "1", 1_600_000_000), (9, "t", 1_588_741_689)]


def test_media_by_example(texts):
    got = rows_of(story_trees.media(texts, "value", "pos"))
    assert got == [(1, "deep", "http://d"), (2, "p", "http://v"), (2, "p", "http://w"), (3, "1", "http://i")]


def test_empty_tables(spark, texts):
    none = texts.where("pos < 0")
    assert story_trees.times(none, "value", "pos").count() == story_trees.media(none, "value", "pos").count() == 0
