"""The index of vectors and the inverted index against plain comparison with all rows."""

import math
import random
import re

import numpy as np
import pytest

from lodestone.operators import inverted, retrieval, vector_index

VECTORS = "vec_id long, embedding array<double>"


def nearest(rows, queries, most):
    """query -> its nearest (distance, id), itself left out; every pair is compared."""
    ok = lambda v: v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    size = max(len(v) for _, v in rows if v) if rows else 0
    good = [(i, np.array(v)) for i, v in rows if ok(v) and len(v) == size]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    return {q: sorted((round(1 - cos(np.array(v), x), 6), i) for i, x in good if i != q)[:most] for q, v in queries if ok(v) and len(v) == size}


def clustered(n, centres, seed=2, size=16):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, size))
    return [(k, (middle[k % centres] + 0.15 * r.normal(size=size)).tolist()) for k in range(n)]


def odd(size=16):
    return [(9001, None), (9002, [0.0] * size), (9003, [1.0] * (size - 1)), (9004, [float("nan")] + [1.0] * (size - 1)), (9005, [float("inf")] + [1.0] * (size - 1)), (9006, [None] + [1.0] * (size - 1)), (9007, [])]


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "few"])
def test_exact_answers(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_index, "PACK", 50)  # a cell is many parts
    rows = {"clusters": clustered(700, 9), "noise": clustered(400, 400), "ties": clustered(6, 6) * 40, "few": clustered(3, 2)}[kind]
    rows = [(k, v) for k, (_, v) in enumerate(rows)] + odd()
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] > 9000]
    index = vector_index.build(spark.createDataFrame(rows, VECTORS).withColumn("cell", vector_index.F.lit(1)).repartition(3))
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = {}
    for r in vector_index.search(index, asked, 7, exact=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    want = nearest(rows, queries, 7)
    assert got.keys() == {q for q, n in want.items() if n}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [round(d, 6) for _, d, _ in found] == pytest.approx([d for d, _ in want[q]], abs=2e-6)
        if kind != "noise":
            assert len({i for _, _, i in found} & {i for _, i in want[q]}) >= len(found) - (2 if kind == "clusters" else 0)
    if kind == "ties":
        assert [i for _, _, i in got[0]] == [6 * k for k in range(1, 8)], "ties are ordered by id"


def test_tasks_work_in_bounded_pieces(spark, monkeypatch):
    pieces = vector_index.slices(10_000, 2_450)
    assert sum(len(range(10_000)[p]) for p in pieces) == 10_000 and all(len(range(10_000)[p]) * 2_450 * 8 <= vector_index.MATRIX_BYTES for p in pieces)
    frame = spark.createDataFrame(clustered(300, 40), VECTORS)
    index, asked = vector_index.build(frame), frame.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = sorted(map(tuple, vector_index.search(index, asked, 3, exact=True).collect()))
    monkeypatch.setattr(vector_index, "BATCH_BYTES", 1)  # a query's cell is a batch
    assert sorted(map(tuple, vector_index.search(index, asked, 3, exact=True).collect())) == found and len(found) == 90


def test_reads_grow_slower_than_the_table(spark):
    """Sixteen times the vectors: recall stays, and a query reads far less than sixteen times as many."""
    share, recall = {}, {}
    for n in (500, 8000):
        rows = clustered(n, n // 20)
        frame = spark.createDataFrame(rows, VECTORS)
        index, asked = vector_index.build(frame), frame.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")
        true = {(r.query_id, r.vec_id) for r in vector_index.search(index, asked, 5, exact=True).collect()}
        recall[n] = len(true & {(r.query_id, r.vec_id) for r in vector_index.search(index, asked, 5).collect()}) / len(true)
        share[n] = np.mean([r.read for r in vector_index.rows_read(index, asked).collect()])
    assert min(recall.values()) >= 0.9 and share[8000] < 8 * share[500], (recall, share)


def test_recall_on_the_given_vectors(spark, sf_dir):
    from lodestone.plans.catalogue import QUERIES

    rows = QUERIES["semantic_index_recall"](spark, sf_dir).collect()
    assert rows and sum(r.found for r in rows) >= 0.9 * sum(r.nearest for r in rows)


def test_no_vectors(spark):
    index = vector_index.build(spark.createDataFrame([], VECTORS))
    assert not vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3, exact=True).count()


def test_stored_cells_are_skipped(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame(clustered(300, 5), VECTORS), str(tmp_path / "cells"))
    plan = index.parts.where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert "In(cell, [1,2])" in plan
    assert sum(len(r.ids) for r in index.parts.collect()) == 300


POSTS = "id long, content_text string, created_at timestamp, reshared_from_author string"


def texts(n=400, seed=4):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    words = [f"word{k}" for k in range(40)] + ["Übung", "ünder", "tea-pot", "x1", "kettle's", "İstanbul"]
    start = datetime(2020, 1, 1)
    rows = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(words[r.randrange(30) :]) for _ in range(r.randint(1, 30))), start + timedelta(hours=k % 90), "") for k in range(n)]
    return rows + [(n, None, start, ""), (n + 1, "", None, ""), (n + 2, "-- !! ++++", None, "a"), (n + 3, "word1 " * 500, None, "")]


@pytest.mark.parametrize("question", ["word1", "word3 word39 übung", "unknown", "tea-pot", "ord2", "rd1 te", "++++", "kettle's x1", "ünder wor", "ORD33", "a"])
def test_keyword_hits(spark, monkeypatch, question):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    posts = spark.createDataFrame(texts(), POSTS).repartition(3).cache()
    index = inverted.build(posts)
    for most in (5, 40, 500):
        want = retrieval.keyword(posts, question, most).collect()
        assert sorted(map(tuple, inverted.keyword(index, posts, question, most).collect())) == sorted(map(tuple, want))


def test_tasks_hold_blocks_not_shares_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    rows = texts()
    index = inverted.build(spark.createDataFrame(rows, POSTS))
    got = {(r.token, p.id): (p.times, p.length) for r in index.postings.collect() for p in r.posts}
    words = {k: re.findall(r"word\d+", text or "") for k, text, _, _ in rows}
    assert {k: n for k, (n, _) in got.items() if k[0].startswith("word")} == {(w, k): x.count(w) for k, x in words.items() for w in set(x)}
    assert got["word1", 403] == (500, 500)
    assert index.postings.rdd.getNumPartitions() == -(-len(rows) // 16), "as many parts as blocks"


def test_only_asked_postings_are_read(spark, tmp_path):
    posts = spark.createDataFrame(texts(), POSTS)
    index = inverted.build(posts, str(tmp_path / "index"))
    hits, full = inverted.best_hits(index, ["word1", "word7"], 10)
    assert full and "In(token, [word1,word7])" in hits._jdf.queryExecution().toString()
    want = retrieval.keyword(posts, "word1 word7", 10).collect()
    assert sorted(map(tuple, inverted.keyword(index, posts, "word1 word7", 10).collect())) == sorted(map(tuple, want))


def test_blocks_that_cannot_reach_the_last_hit(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 4)
    posts = spark.createDataFrame([(k, "word " * (50 if k < 3 else 1) + "filler " * (20 if k > 2 else 0), None, "") for k in range(200)], POSTS)
    index = inverted.build(posts)
    hits, full = inverted.best_hits(index, ["word"], 3)
    assert full and {r.id for r in hits.collect()} == {0, 1, 2}


def test_empty_index(spark):
    posts = spark.createDataFrame([], POSTS)
    assert not inverted.keyword(inverted.build(posts), posts, "word", 5).count()


def test_stemmed_index(spark):
    from pyspark.sql import functions as F

    posts = spark.createDataFrame([(1, "cats cat dog", None, ""), (2, "cat", None, ""), (3, "dogs", None, "")], POSTS)
    index = inverted.build(posts, stem=lambda w: F.regexp_replace(w, "s$", ""))
    got = {r.id: r.keyword_rank for r in inverted.best_hits(index, inverted.asked_for(index, "Cats"), 2)[0].collect()}
    assert got == {1: round(2 / (1 + math.log(3)), 9), 2: 1.0} and inverted.asked_for(index, "cats") == ["cat"]
