"""State with timers and snapshots of keyed rows: order of files, expiry, broken and replayed batches."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.streaming import events as S
from lodestone.streaming import snapshots, stateful

DAY, START = 86_400, 1_700_000_000


def put(spark, rows, folder, schema):
    """One file for each list of rows, in the order of their names."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    paths = f"{folder}/*"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(paths)
    return stream.withColumn("ts", F.timestamp_seconds(F.col("at") + START)).drop("at")


WRITES = "question bigint, model string, event_id bigint, at bigint"


def answers(writes, asked="base-3"):
    """question -> (model, event_id), writes in the order of their times."""
    held = {}
    for q, m, e, at in sorted(writes, key=lambda w: (w[3], w[2])):
        own = held.setdefault(q, {})
        if m == "premium":
            own.clear()
        own[m] = (at, e)
    return {q: (m, rows[m][1]) for q, rows in held.items() if (m := stateful.preferred(rows, asked, "premium"))}


@pytest.mark.parametrize("order", ["time", "backwards", "shuffled"])
def test_cache_in_any_order_of_files(spark, tmp_path, order):
    r = random.Random(3)
    writes = [(r.randrange(12), r.choice(["base", "base-3", "base-3-x", "other", "other", "premium"]), k, k % 90 * 10) for k in range(240)]
    parts = sorted(writes, key=lambda w: w[3])
    parts = [parts[k : k + 40] for k in range(0, 240, 40)]
    parts = parts[::-1] if order == "backwards" else parts
    if order == "shuffled":
        r.shuffle(writes)
        parts = [writes[k : k + 40] for k in range(0, 240, 40)]
    sent = S.drained(stateful.cache(put(spark, parts, tmp_path, WRITES), "base-3"), "update", ["question"], rocks=True)
    assert {r.question: (r.model, r.event_id) for r in sent.collect() if r.model} == answers(writes)


def test_preference():
    rows = {"base": (1, 1), "base-3-x": (2, 2), "premium": (0, 0), "other": (9, 9)}
    assert stateful.preferred(rows, "base-3", "premium") == "base-3-x" and stateful.preferred(rows, "other", "premium") == "other"
    assert stateful.preferred({"premium": (0, 0)}, "x", "premium") == "premium" and stateful.preferred({"other": (0, 0)}, "premium", "premium") is None and stateful.preferred({}, "x", "premium") is None


def test_answers_expire(spark, tmp_path):
    """Three days to live: the watermark, a day behind, passes the first answer's end in the third file, and the timer fires after it."""
    parts = [[(1, "base-3", 1, 0)], [(1, "base", 2, 2 * DAY)], [(2, "base-3", 3, 5 * DAY)], [(2, "base-3", 4, 5 * DAY + 1)]]
    stream = stateful.cache(put(spark, parts, tmp_path, WRITES), "base-3", live_s=3 * DAY)
    sent = S.drained(stream, "update", ["question"], rocks=True)
    assert {r.question: r.model for r in sent.collect()} == {1: "base", 2: "base-3"}


ITEMS = "key string, seq bigint, body string, at bigint"


def test_harvest_forgets_keys(spark, tmp_path):
    parts = [[("a", 1, "long text", 0), ("b", 2, "x", 0), ("b", 1, "y", 0), (None, 9, None, 0)], [("a", 3, "short", DAY)], [("c", 4, "z", 9 * DAY)], [("c", 5, "z", 9 * DAY)], [("a", 6, "new", 9 * DAY)]]
    stream = stateful.harvest(put(spark, parts, tmp_path, ITEMS), live_s=3 * DAY)
    sent = S.drained(stream, "update", rocks=True)
    got = sorted((r.key or "-", r.seq, r.body) for r in sent.collect())
    assert got == [("-", 9, None), ("a", 1, "long text"), ("a", 6, "new"), ("b", 1, "y"), ("c", 4, "z")], "a came anew after it was forgotten"
    forever = S.drained(stateful.harvest(put(spark, parts, tmp_path / "again", ITEMS)), "update", ["key"], rocks=True)
    assert {(r.key, r.seq) for r in forever.collect()} == {("a", 1), ("b", 1), ("c", 4), (None, 9)}


def test_days_backwards(spark, tmp_path):
    """Nothing is forgotten, so that nothing is late: not a file of nine days before the first one's rows either."""
    parts = [[("a", 3, "xx", 9 * DAY)], [("b", 2, "y", 5 * DAY), ("a", 2, "yyy", 5 * DAY)], [("a", 1, "zzz", 0), ("c", 0, "q", 0), ("b", 4, None, 0)]]
    sent = S.drained(stateful.harvest(put(spark, parts, tmp_path / "items", ITEMS)), "update", ["key"], rocks=True)
    assert {(r.key, r.seq, r.body) for r in sent.collect()} == {("a", 1, "zzz"), ("b", 2, "y"), ("c", 0, "q")}
    writes = [[(1, "base-3", 3, 9 * DAY)], [(2, "base", 2, 5 * DAY)], [(3, "base-3", 1, 0), (1, "premium", 4, 0)]]
    sent = S.drained(stateful.cache(put(spark, writes, tmp_path / "writes", WRITES), "base-3"), "update", ["question"], rocks=True)
    assert {(r.question, r.model, r.event_id) for r in sent.collect()} == {(1, "base-3", 3), (2, "base", 2), (3, "base-3", 1)}


def test_harvest_of_rows_without_seq(spark, tmp_path):
    parts = [[("a", None, "xx", 0), ("a", 4, "yy", 0), ("b", 5, "z", 0), ("b", None, "zz", 0), ("c", 2**60 + 1, None, 0)], [("c", None, "", 0), ("d", None, None, 0), ("b", 6, "yy", 0)]]
    sent = S.drained(stateful.harvest(put(spark, parts, tmp_path, ITEMS)), "update", ["key"], rocks=True)
    assert {(r.key, r.seq, r.body) for r in sent.collect()} == {("a", 4, "yy"), ("b", 6, "yy"), ("c", 2**60 + 1, None), ("d", None, None)}


def test_harvest_forgets_keys_of_a_bucket(spark, tmp_path):
    """All in one bucket: a and b end at once, but a goes on; c comes between."""
    parts = [[("a", 1, "long", 0), ("b", 2, "long", 0), ("c", 3, "long", 0)], [("a", 4, "x", 2 * DAY)], [("d", 5, "y", 4 * DAY + 1)], [("d", 6, "y", 4 * DAY + 1)], [("a", 7, "new", 4 * DAY), ("b", 8, "new", 4 * DAY), ("c", 9, "new", 4 * DAY)]]
    stream = stateful.harvest(put(spark, parts, tmp_path, ITEMS), live_s=3 * DAY, buckets=1)
    got = sorted((r.key, r.seq, r.body) for r in S.drained(stream, "update", rocks=True).collect())
    assert got == [("a", 1, "long"), ("b", 2, "long"), ("b", 8, "new"), ("c", 3, "long"), ("c", 9, "new"), ("d", 5, "y")]


class Maps:
    """A processor's state in dicts, and how often it was asked for or written."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, name, *_):
        held = {}

        class State:
            def getValue(_, key):
                self.calls += 1
                return held.get(key)

            def updateValue(_, key, value):
                self.calls += 1
                held[key] = value

        return State()

    def registerTimer(self, at):
        self.timers.append(at)


def test_harvest_takes_a_bucket_at_a_time(spark):
    """500 keys of a bucket in one frame; the state is asked once for a key, however many rows it has, and written if its text is longer."""
    harvest, state = stateful.Harvest(None), Maps()
    harvest.init(state)
    rows = spark.range(2000).selectExpr("concat('k', id % 500) as key", "id as seq", "repeat('x', cast(id div 500 % 3 as int)) as body", "timestamp_seconds(id) as ts")
    rows = stateful.keyed(rows).toPandas()
    (sent,) = harvest.handleInputRows((0,), iter([rows[:700], rows[700:]]), None)
    assert {(k, s, b) for k, s, b in sent[["key", "seq", "body"]].values.tolist()} == {(f"k{k}", 1000 + k, "xx") for k in range(500)}
    assert state.calls == 1000
    assert not list(harvest.handleInputRows((0,), iter([rows]), None)) and state.calls == 1500 and not state.timers


def batch(spark, **rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], "k string, v long")


def state(spark, folder, version=None):
    return {r.k: r.v for r in snapshots.read(spark, folder, ["k"], version).collect()}


def test_versions_folds_and_vacuum(spark, tmp_path):
    folder, want, seen = str(tmp_path / "s"), {}, []
    write = snapshots.sink(folder, ["k"], fold=2)
    for n in range(7):
        changed = {f"k{n % 3}": n, "all": n}
        write(batch(spark, **changed), n)
        want |= changed
        seen.append(dict(want))
        assert state(spark, folder) == want
    assert snapshots.versions(spark, folder) == list(range(7)) and [state(spark, folder, v) for v in range(7)] == seen
    assert snapshots.manifest(spark, folder, 6).base == 5
    snapshots.vacuum(spark, folder, keep=2)
    assert snapshots.versions(spark, folder) == [5, 6] and state(spark, folder, 5) == seen[5] and state(spark, folder) == want
    with pytest.raises(ValueError, match="no snapshot 3"):
        snapshots.read(spark, folder, ["k"], 3)
    assert len(list((tmp_path / "s/base").iterdir())) == 1 and len(list((tmp_path / "s/changes").iterdir())) == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    write = snapshots.sink(folder, ["k"])
    write(batch(spark, a=1), 0)
    write(batch(spark, a=2, b=None), 1)
    write(batch(spark, a=99), 1)
    write(batch(spark, a=98), 0)
    assert state(spark, folder) == {"a": 2, "b": None} and snapshots.versions(spark, folder) == [0, 1]


def test_nothing_is_there(spark, tmp_path):
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read(spark, str(tmp_path / "none"), ["k"])
    snapshots.sink(str(tmp_path / "s"), ["k"])(batch(spark).limit(0), 0)
    assert state(spark, str(tmp_path / "s")) == {}


def test_a_stream_that_breaks_off_and_goes_on(spark, tmp_path):
    """Broken after the changes and before the manifest: the snapshot before stays, and the next run equals one that never broke."""
    rows = spark.range(60).selectExpr("id as event_id", "id % 7 as user_id", "'t' as event_type", "repeat('x', cast(id * 31 % 23 as int)) as props", "timestamp '2024-01-01' as ts")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    folder, keys = str(tmp_path / "s"), ["user_id", "event_type"]
    write = snapshots.sink(folder, keys, fold=2)

    def broken(df, number):
        if number == 3:
            df.write.parquet(f"{folder}/changes/batch={number}")
            raise RuntimeError("broken off")
        write(df, number)

    def run(sink):
        S.run(S.longest_of_key(S.event_stream(spark, str(tmp_path / "in"), files=1), keys, "props", "event_id"), "update", str(tmp_path), sink)

    with pytest.raises(StreamingQueryException):
        run(broken)
    assert snapshots.versions(spark, folder) == [0, 1, 2]
    run(write)
    run(write)
    got = {(r.user_id, r.event_id, r.props) for r in snapshots.read(spark, folder, keys).collect()}
    best = {}
    for r in rows.collect():
        best[r.user_id] = max(best.get(r.user_id, (-1, 0, "")), (len(r.props), -r.event_id, r.props))
    assert got == {(u, -e, p) for u, (_, e, p) in best.items()}
