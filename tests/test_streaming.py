from pyspark.sql import functions as F

from lodestone.operators import rolling
from lodestone.plans import streams
from lodestone.streaming import events as S


def test_stream_admission_equals_batch(spark, sf_dir, tmp_path):
    """Batch by batch: events dealt over files in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for a in (1, 11, 21):
        part = events.where(f"dayofmonth(ts) between {a} and {a + 9}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = S.drained(S.admitted(S.event_stream(spark, str(tmp_path / "in"), files=1), 3), "append")
    rows = events.where("dayofmonth(ts) <= 30").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    want = rolling.admitted(rows, "event_id", "user_id", "at", 3, 86_400_000_000)
    assert {(r.event_id, r.admitted) for r in got.select("event_id", "admitted").collect()} == {(r.event_id, r.admitted) for r in want.collect()}


def test_first_of_key_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in (rows.where("user_id = 1"), rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = S.drained(S.first_of_key(S.event_stream(spark, str(tmp_path / "in"), files=1), ["user_id"]).select("user_id"), "append")
    assert sorted(r.user_id for r in got.collect()) == [1, 2]


def put_events(spark, rows, folder, parts):
    """`rows` (event_id, user_id, event_type, ts) as `parts` files, each with the rows whose `part` it is."""
    for k in range(parts):
        rows.where(f"part = {k}").drop("part").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_stream_dedup_keeps_keys_of_any_time(spark, tmp_path):
    """Seventeen files, so three batches, as late rows are dropped by the watermark of the batch before: the last has a key of months before."""
    rows = spark.sql("select id as event_id, id % 3 as user_id, 'view' as event_type, timestamp '2024-06-01' as ts, id div 3 as part from range(48)")
    rows = rows.unionByName(spark.sql("select 100 as event_id, 7 as user_id, 'view' as event_type, timestamp '2024-01-01' as ts, 16 as part union all select 101, 1, 'view', timestamp '2025-06-01', 16"))
    put_events(spark, rows, tmp_path, 17)
    got = streams.stream_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.event_type) for r in got) == [(0, "view"), (1, "view"), (2, "view"), (7, "view")]


def test_first_of_key_drops_what_is_late(spark, tmp_path):
    """The general form forgets: a key behind the watermark of the batch before is lost, one within it is not."""
    rows = spark.sql("select id as event_id, id as user_id, 'view' as event_type, to_timestamp(at) as ts, part from values (1, '2024-06-01', 0), (1, '2024-06-01', 1), (2, '2024-01-01', 2), (3, '2024-05-20', 2) as t(id, at, part)")
    put_events(spark, rows, tmp_path, 3)
    got = S.drained(S.first_of_key(S.event_stream(spark, f"{tmp_path}/events.parquet", files=1), ["user_id"], "30 days").select("user_id"), "append")
    assert sorted(r.user_id for r in got.collect()) == [1, 3]


def batch_admission(rows):
    want = rolling.admitted(rows.withColumn("at", F.unix_micros("ts")), "event_id", "user_id", "at", 3, 86_400_000_000)
    return sorted((r.event_id, r.admitted) for r in want.collect())


def test_stream_admitted_in_any_order(spark, tmp_path):
    """Files from the latest to the earliest, and more rows of a user than an Arrow batch holds."""
    rows = spark.sql("select id as event_id, cast(pow(id % 4, 2) as bigint) div 4 as user_id, 'view' as event_type, timestamp '2024-01-01' + make_dt_interval(0, cast(id * 7919 % 2400 as int) div 2, 0, cast(id % 3 as decimal(18, 6)) / 1000000) as ts from range(3000)")
    rows = rows.withColumn("part", F.lit(9) - F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6)).localCheckpoint()
    put_events(spark, rows, tmp_path, 10)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = sorted((r.event_id, r.admitted) for r in streams.stream_admitted(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == batch_admission(rows)


def test_admission_lets_go_behind_the_watermark(spark, tmp_path):
    """In order but for two days, with a delay of three: the same as the batch, and equal calls are told apart."""
    rows = spark.sql("select id div 2 as event_id, id div 2 % 3 as user_id, 'view' as event_type, timestamp '2024-01-01' + make_dt_interval(0, cast(id div 2 as int), 0, 0) as ts, id div 2 div 48 as part from range(960)")
    rows = rows.withColumn("ts", F.when(F.col("event_id") % 5 == 0, F.expr("ts - interval 2 days")).otherwise(F.col("ts"))).localCheckpoint()
    put_events(spark, rows, tmp_path, 10)
    got = S.drained(S.admitted(S.event_stream(spark, f"{tmp_path}/events.parquet", files=1), 3, late="3 days"), "append", S.CALL)
    assert sorted((r.event_id, r.admitted) for r in got.collect()) == batch_admission(rows)
