"""Sinks, the snapshot cache, digests of addresses, collation, and joins that can split a hot key."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import harvest, links, retrieval, slugs
from lodestone.sources import sinks, web_archive


def exchanges_below_join(df):
    """Whether both sides of the last sort-merge join have an exchange that the join itself asked for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ENSURE_REQUIREMENTS")


@pytest.mark.parametrize("made", [
    lambda e: links.seen_once(e, "owner", "path"),
    lambda e: links.reshare_states(e.selectExpr("id", "id as seq", "true as reshare", "id % 2 = 0 as own", "'p' as segment", "'w' as commentary", "'' as target", "path as text")),
    lambda e: slugs.unique(e.selectExpr("id", "path as base"), "base", ["id"]),
])
def test_aggregates_joined_back_have_exchanges_of_their_own(spark, made):
    """One for the sum by key, and one for each side of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = made(spark.range(100).selectExpr("id", "id % 3 as owner", "concat('p', id % 4) as path"))
        assert exchanges_below_join(df) >= 3 and df.count() >= 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_links(spark, tmp_path):
    rows = [('Ann "A" \\ Lee', "https://f.example/a?b=1"), ("Zoë\n2", "u"), ("Zoë\n2", "t"), ("", "empty name"), (None, "x"), ("y", None)]
    for name, part in (("all", rows), ("none", [])):
        sinks.write_profile_links(spark.createDataFrame(part, "name string, url string").repartition(3), str(tmp_path / name))
        (file,) = (tmp_path / name).glob("part-*")
        assert json.loads(file.read_text()) == {n: u for n, u in sorted(part, key=repr, reverse=True) if n is not None and u is not None}


def test_media(spark, tmp_path):
    at = datetime(2020, 3, 4)
    files = spark.createDataFrame([("x/y/a.jpg", b"one", at), ("b.jpg", b"two", None), ("", b"none", at)], "name string, content binary, created_at timestamp")
    first = sorted(map(tuple, sinks.copy_media(files, str(tmp_path)).collect()))
    assert first == [("a.jpg", "media/2020/03/a.jpg", True), ("b.jpg", "media/unknown/b.jpg", True)]
    again = sinks.copy_media(files.withColumn("content", F.lit(b"other")), str(tmp_path)).collect()
    assert not any(r.copied for r in again) and (tmp_path / "media/2020/03/a.jpg").read_bytes() == b"one"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.jpg", "b.jpg"]


def test_snapshot_cache(spark, tmp_path):
    def searched(handle):
        if handle == "down":
            raise OSError("no answer")
        if handle == "once":
            raise AssertionError("is in the cache")
        return [("20190101000000", f"https://twitter.com/{handle}/status/1"), ("20190101000000", f"https://twitter.com/{handle}")] if handle != "none" else []

    def known(handle):
        return [("20180101000000", f"https://twitter.com/{handle}/status/7")]

    cache = str(tmp_path / "cache")
    asked = lambda *names: spark.createDataFrame([(n,) for n in names], "handle string")
    web_archive.snapshot_lists(asked("once"), cache, known)
    handles = asked(" @Once", "new", "NEW", "none", "down", "", None)
    for _ in range(2):
        got = web_archive.snapshot_lists(handles, cache, searched).collect()
        assert sorted((r.handle, r.timestamp) for r in got) == [("new", "20190101000000"), ("once", "20180101000000")]
    held = {r.handle: r.found for r in spark.read.parquet(cache).collect()}
    assert held == {"once": True, "new": True, "none": False}, "what can't be found is remembered, what failed isn't"


def test_addresses(spark):
    rows = [(" 1.1.1.1 ", "2.2.2.2", "3"), ("", "2.2.2.2 , 4", "3"), (None, None, "3"), (None, "", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    address = T.caller_address(F.col("a"), F.col("b"), F.col("c"))
    got = df.select(address.alias("x"), T.address_digest(address, "s").alias("d")).collect()
    assert [r.x for r in got] == ["1.1.1.1", "2.2.2.2", "3", None] and got[3].d == "" and len({r.d for r in got}) == 4
    assert got[2].d == __import__("hashlib").sha256(b"s|3").hexdigest()


def test_collation(spark):
    df = spark.createDataFrame([(w,) for w in "z é e Z a B ü".split()], "w string")
    assert [r.w for r in harvest.collated(df, "w").collect()] == "a B e é ü z Z".split()


def test_first_of_breaks_ties_by_id(spark):
    rows = [(k, [1.0, 0.0]) for k in range(50)] + [(99, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = retrieval.nearest_batch(df.where("vec_id in (3, 99)").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(3, k, v) for k, v in enumerate((0, 1, 2, 4, 5), 1)] + [(99, k, v) for k, v in enumerate(range(5), 1)]
    with pytest.raises(Exception, match="numbers"):
        retrieval.nearest_batch(df.where("vec_id = 3").withColumnRenamed("vec_id", "query_id"), spark.createDataFrame([(1, [1.0, 2.0, 3.0])], df.schema), 5).collect()
