"""Ranked search against plain scores of every document, and the descent itself."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import oracle, rows

from lodestone.llm import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(ranked.UPPER, ranked.LOWER)


def terms(text):
    return re.findall(ranked.TERM, (text or "").translate(LOW))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    found = [(d[0], terms(d[1])) for d in docs]
    found = [x for x in found if x[1]]
    n, length = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for doc, t in found:
            m = 25 + 75 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in df and x in t)
            scored += [(-score, doc is None, doc)] if score > 0 else []
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k + 1, s[2], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(out, key=repr)


def corpus(n=1500, seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "été", "日本", "İ", "ﬁ", "x" * 300]
    text = lambda: r.choice([" ", "-", "\n", "/"]).join(r.choice(vocabulary[: r.choice([8, 66])]) for _ in range(r.randint(1, 25)))
    docs = [(k * 7 % n, text(), "en", "s", 1) for k in range(n)]
    docs += [(n + k, docs[3][1], "en", "s", 1) for k in range(40)]  # ties
    docs += [docs[5], docs[5], (None, docs[3][1], "en", "s", 1), (n + 50, None, None, None, None), (n + 51, "", "en", "s", 0), (n + 52, " .,;", "en", "s", 4), (n + 53, "W1 w1 w1\x00w2" * 3000, "en", "s", 1)]
    return docs, [(k, text()) for k in range(25)] + [(100, docs[3][1]), (100, "w1 w1 W1"), (101, None), (102, "..."), (103, "unknown"), (None, "été w5")]


def ran(spark, docs, items, parts):
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as item", "lang as term").repartition(parts)
    got = ranked.search(ranked.index(frame), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as item", "'x' as score"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 9])
def test_all_scores(spark, parts):
    docs, items = corpus()
    assert ran(spark, docs, items, parts) == plain(docs, items)


def test_few(spark):
    docs, items = corpus()
    assert ran(spark, [], items, 1) == [] and ran(spark, docs[:5], [], 1) == [] and ran(spark, docs[:5], [(1, None)], 1) == []
    assert ran(spark, docs[:6], items, 2) == plain(docs[:6], items)
    assert ran(spark, [docs[1]] * 30, items, 4) == plain([docs[1]] * 30, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(200)
    monkeypatch.setattr(ranked, "ENTRIES", 60)
    assert ran(spark, docs, items, 3) == plain(docs, items)


def test_written_index(spark, tmp_path):
    docs, items = corpus(300)
    found = ranked.index(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "index"))
    for _ in range(2):
        got = ranked.search(found, spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_descent_opens_few_ranges(monkeypatch):
    """Of 64 ranges only those are scored whose bound reaches the k-th score, equal ones among them."""
    shard = ranked.Shard()
    for k in range(4096):
        shard.add(k, ranked.counted(b"common " * (1 + (k % 64 == 0)) + (b"rare " if k in (70, 3000, 3001) else b"") + b"filler " * 20))
    batch = shard.row(0, 4096, 4096 * 22)
    names = batch["terms"][0].as_py()
    ranges = ranked.Ranges(ranked.unpacked(batch, 0), np.arange(len(names)))
    opened = []
    scores = ranked.Ranges.scores
    monkeypatch.setattr(ranked.Ranges, "scores", lambda self, block, *more: opened.append(block) or scores(self, block, *more))
    docs = batch["docs"][0].as_py()
    best = ranges.best(np.array([names.index(b"rare")]), np.array([7]), 1, docs, 3)
    assert [d for _, d in sorted(best, key=lambda x: (-x[0], x[1]))] == [70, 3000, 3001] and set(opened) == {1, 46}
    opened.clear()
    best = ranges.best(np.array([names.index(b"common")]), np.array([7]), 1, docs, 10)
    assert len(opened) == 64 and sorted(d for _, d in best) == [64 * k for k in range(10)], "all ranges tie, the smallest ids win"
    assert isinstance(batch, pa.RecordBatch) and batch.num_rows == 1


def test_long_texts_in_pieces(monkeypatch):
    data = " ".join(f"w{k % 97}" for k in range(5000)).encode()
    whole = ranked.counted(data)
    monkeypatch.setattr(ranked, "PIECE", 100)
    assert ranked.counted(data) == whole and ranked.counted(b"x" * 1000) == {b"x" * 1000: 1} and not ranked.counted(b"")


def test_sql(spark, sf_dir):
    assert rows(ranked.query(spark, sf_dir).toPandas()) == rows(oracle(sf_dir).sql(ranked.RANKED_SQL).df())
