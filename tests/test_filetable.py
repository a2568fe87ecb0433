"""Merges by files against a dictionary, and how many files they read."""

import random

import pytest

from lodestone.operators import filetable, merge

SCHEMA = "k {}, v string, seq int"


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, SCHEMA.format(kind))


def upsert(old, new):
    return merge.upsert(old, new, ["k"], "seq")


def state(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_merges(spark, tmp_path, kind):
    r, folder = random.Random(8), str(tmp_path / "t")
    key = (lambda k: k) if kind == "long" else (lambda k: f"ключ-{k:04d}")
    want = {key(k): f"old {k}" for k in range(0, 400, 2)}
    filetable.create(frame(spark, [(k, v, 0) for k, v in want.items()], kind), folder, "k", 25)
    assert state(filetable.read(spark, folder)) == sorted(want.items(), key=repr)
    kept = [dict(want)]
    for turn in range(4):
        low = r.randrange(-40, 420)
        rows = [(key(low + r.randrange(40)), f"new {turn} {k}", k) for k in range(30)] if turn != 2 else [(key(k), "far", 1) for k in (-999, 5000)]
        done = filetable.merge(spark, folder, "k", frame(spark, rows, kind), upsert, 25)
        for k, v, _ in rows:
            want[k] = v
        assert state(filetable.read(spark, folder)) == sorted(want.items(), key=repr)
        assert done.version == turn + 1 and done.files >= 8 and done.read <= 5, "a narrow band is a few files"
        kept.append(dict(want))
    files = filetable.files_of(filetable.manifest(spark, folder))
    assert all(a.high < b.low for a, b in zip(files, files[1:])), "files don't overlap"
    assert all(state(filetable.read(spark, folder, v)) == sorted(x.items(), key=repr) for v, x in enumerate(kept)), "earlier versions stay"


def test_only_touched_files_are_written(spark, tmp_path):
    folder = str(tmp_path / "t")
    filetable.create(frame(spark, [(k, "v", 0) for k in range(1000)]), folder, "k", 100)
    before = {r.file for r in filetable.files_of(filetable.manifest(spark, folder))}
    done = filetable.merge(spark, folder, "k", frame(spark, [(500, "x", 1)]), upsert, 100)
    after = {r.file for r in filetable.files_of(filetable.manifest(spark, folder))}
    assert done.read == 1 and len(before - after) == 1 and len(before & after) == done.files - 1
    assert filetable.read(spark, folder).count() == 1000


def test_drops_and_children(spark, tmp_path):
    folder = str(tmp_path / "t")
    filetable.create(frame(spark, [(k // 3, f"child {k}", k) for k in range(300)]), folder, "k", 30)
    new = frame(spark, [(10, "only", 0), (50, "a", 0), (50, "b", 1)])
    done = filetable.merge(spark, folder, "k", new, lambda old, x: merge.replace_children(old, x, "k"), 30)
    got = state(filetable.read(spark, folder))
    assert done.read == 2 and len(got) == 300 - 6 + 3 and {v for k, v in got if k in (10, 50)} == {"only", "a", "b"}
    gone = frame(spark, [(k, "", 0) for k in range(40)])
    filetable.merge(spark, folder, "k", gone, lambda old, x: merge.delete_parents(old, x, "k"), 30)
    assert {k for k, _ in state(filetable.read(spark, folder))} == set(range(40, 100))


def test_null_and_repeated_keys_and_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    filetable.create(frame(spark, [(None, "no key", 0)] * 3 + [(7, f"same {k}", k) for k in range(90)] + [(9, "x", 0)]), folder, "k", 20)
    done = filetable.merge(spark, folder, "k", frame(spark, [(7, "one", 0)]), lambda old, x: merge.replace_children(old, x, "k"), 20)
    assert state(filetable.read(spark, folder)) == sorted([(None, "no key")] * 3 + [(7, "one"), (9, "x")], key=repr) and done.version == 1
    none = filetable.merge(spark, folder, "k", frame(spark, []), upsert, 20)
    assert none.read == 0 and filetable.read(spark, folder).count() == 5
    empty = str(tmp_path / "e")
    filetable.create(frame(spark, []), empty, "k")
    assert filetable.read(spark, empty).count() == 0
    filetable.merge(spark, empty, "k", frame(spark, [(1, "a", 0)]), upsert)
    assert state(filetable.read(spark, empty)) == [(1, "a")]
    with pytest.raises(ValueError, match="no version"):
        filetable.read(spark, empty, 9)


def test_a_task_writes_many_files(spark, tmp_path, monkeypatch):
    tasks, ranged = [], type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *cols: tasks.append(n) or ranged(self, n, *cols))
    folder, rows = str(tmp_path / "t"), [(k // 7, f"child {k}", k) for k in range(2000)]
    filetable.create(frame(spark, rows), folder, "k", 10)
    files = filetable.files_of(filetable.manifest(spark, folder))
    assert len(files) >= 200 and tasks[0] <= 10 and max(r.rows for r in files) == 10, "keys of seven rows don't fit into ten evenly"
    assert any(a.high == b.low for a, b in zip(files, files[1:]))
    want = [(k, v) for k, v, _ in rows if k not in (1, 20, 21, 100, 285)] + [(k, "only") for k in (1, 20, 21, 100, 285)]
    new = frame(spark, [(k, "only", 0) for k in (1, 20, 21, 100, 285)])
    done = filetable.merge(spark, folder, "k", new, lambda old, x: merge.replace_children(old, x, "k"), 10)
    assert state(filetable.read(spark, folder)) == sorted(want, key=repr) and done.read <= 15
    again = filetable.merge(spark, folder, "k", frame(spark, [(20, "again", 0), (50, "again", 0)]), lambda old, x: merge.replace_children(old, x, "k"), 10)
    want = [(k, v) for k, v in want if k not in (20, 50)] + [(20, "again"), (50, "again")]
    assert state(filetable.read(spark, folder)) == sorted(want, key=repr) and again.read <= 6
