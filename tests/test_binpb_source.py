"""The data source of record files: ranges of one file, commits, lost attempts and broken bytes."""

import struct
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import binpb, binpb_source, schema


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(binpb_source.BinpbSource)
    return spark


def frame(spark, n, pad=40):
    rows = spark.range(n).withColumn("id", F.col("id").cast("string"))
    return schema.record(rows, source=F.lit(4), source_id=F.col("id"), created_at=F.timestamp_seconds(F.col("id").cast("long")), content_text=F.concat(F.lit("Ünï "), F.repeat(F.lit("x"), (F.col("id") % pad).cast("int"))), visibility=F.lit(1), tags=F.array(F.lit("a"), F.col("id")), extra=F.create_map(F.lit("k"), F.col("id")))


def files(folder):
    return sorted(p.name for p in Path(folder).iterdir() if p.name.endswith(".binpb"))


def read(spark, folder, size):
    return spark.read.format("binpb").option("rangeBytes", size).load(str(folder))


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
@pytest.mark.parametrize("index", [True, False])
def test_ranges(source, tmp_path, size, index, monkeypatch):
    monkeypatch.setattr(binpb_source, "INDEX", 500)
    rows = frame(source, 150)
    rows.repartition(2).write.format("binpb").mode("append").save(str(tmp_path / "f"))
    if not index:
        for p in (tmp_path / "f").glob("_*.starts"):
            p.unlink()
    back = read(source, tmp_path / "f", size)
    assert back.rdd.getNumPartitions() >= {64: 100, 1000: 8}.get(size, 2)
    assert sorted(map(repr, back.drop("file", "error").collect())) == sorted(map(repr, rows.collect()))
    assert back.where("error is not null").count() == 0


def test_same_files_as_the_plain_reader(source, tmp_path):
    frame(source, 60).write.format("binpb").mode("append").save(str(tmp_path / "f"))
    plain = binpb.read(source, str(tmp_path / "f")).drop("file").collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, read(source, tmp_path / "f", 300).drop("file").collect()))
    one = next((tmp_path / "f").glob("*.binpb"))
    assert read(source, one, 100).count() == binpb.read(source, str(one)).count()


def test_append_and_overwrite(source, tmp_path):
    folder = tmp_path / "f"
    for mode, want in (("append", 10), ("append", 20), ("overwrite", 10)):
        frame(source, 10).write.format("binpb").mode(mode).save(str(folder))
        assert read(source, folder, 1 << 20).count() == want
    assert not list(folder.glob(".*")) and (folder / "_SUCCESS").exists()
    assert len(list(folder.glob("_part*"))) == len(files(folder))


def test_a_failed_task_leaves_no_file(source, tmp_path):
    folder = tmp_path / "f"
    frame(source, 10).write.format("binpb").mode("append").save(str(folder))
    before = files(folder)
    bad = frame(source, 400).withColumn("content_text", F.when(F.col("source_id") == "399", F.raise_error(F.lit("broken row"))).otherwise(F.col("content_text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            bad.repartition(4).write.format("binpb").mode(mode).save(str(folder))
        assert files(folder) == before and not list(folder.glob(".*"))
    assert read(source, folder, 1 << 20).count() == 10


def test_second_attempts_and_aborts(tmp_path):
    writer = binpb_source.BinpbWriter({"path": str(tmp_path)}, False)
    lost, kept = tmp_path / f".{writer.job}-0-1", tmp_path / f".{writer.job}-0-2"
    for path in (lost, kept):
        path.write_bytes(b"x")
        Path(f"{path}.starts").write_text("[0]")
    writer.commit([binpb_source.Written(str(kept), "part-0.binpb", 1), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "_part-0.binpb.starts", "part-0.binpb"]
    other = binpb_source.BinpbWriter({"path": str(tmp_path)}, True)
    left = tmp_path / f".{other.job}-3-9"
    left.write_bytes(b"y")
    other.abort([binpb_source.Written(str(left), "part-3.binpb", 1), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "_part-0.binpb.starts", "part-0.binpb"]


def record(k):
    message = binpb.record_class()(source=4, source_id=str(k))
    message.created_at.FromDatetime(datetime(2020, 1, 1, tzinfo=timezone.utc))
    data = message.SerializeToString()
    return struct.pack(">I", len(data)) + data


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_broken_files(source, tmp_path, size):
    (tmp_path / "cut.binpb").write_bytes(record(1) + record(2) + record(3)[:-2])
    (tmp_path / "head.binpb").write_bytes(record(4) + b"\0\0")
    (tmp_path / "empty.binpb").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no records")
    (tmp_path / ".hidden.binpb").write_bytes(record(9))
    got = sorted((Path(r.file).name, r.source_id, r.error) for r in read(source, tmp_path, size).na.fill("", ["source_id", "error"]).collect())
    assert got == [("cut.binpb", "", "a record is cut short"), ("cut.binpb", "1", ""), ("cut.binpb", "2", ""), ("head.binpb", "", "a record is cut short"), ("head.binpb", "4", "")]


def test_nothing(source, tmp_path):
    assert read(source, tmp_path, 100).count() == 0
    frame(source, 0).write.format("binpb").mode("append").save(str(tmp_path / "f"))
    assert read(source, tmp_path / "f", 100).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        binpb_source.folder_of("hdfs://host/x")
    assert binpb_source.folder_of("file:///x/y") == Path("/x/y") == binpb_source.folder_of("file:/x/y")
