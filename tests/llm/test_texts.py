"""Jaccard join, substring dedup, decontamination and mixing against brute force."""

import hashlib
import random

import pytest

from lodestone.llm import decontaminate, jaccard, mixing, passages

BLANKS = " \t\n\v\f\r"


def split(text):
    for b in BLANKS[1:]:
        text = (text or "").replace(b, " ")
    return [w for w in (text or "").split(" ") if w]


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages and short ones."""
    r = random.Random(seed)
    shared = [words(r, 70) for _ in range(4)]
    out = []
    for k in range(n):
        kind = r.randrange(6)
        text = words(r, r.randint(1, 260))
        if kind == 0 and out:
            text = split(r.choice(out))
        elif kind == 1 and out:
            text = split(r.choice(out))
            for _ in range(max(1, len(text) // 60)):
                text[r.randrange(len(text))] = f"new{k}"
        elif kind == 2:
            at = r.randint(0, len(text))
            text = text[:at] + r.choice(shared) + text[at:]
        elif kind == 3:
            text = text[: r.randint(1, 7)]
        out.append(r.choice([" ", "\n", "  "]).join(text))
    return out


def shingles(text):
    w = split(text)
    n = min(jaccard.N, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    n_links, parent = [0] * len(sets), {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets):
            if a != b and i is not None and j is not None and s and t and len(s & t) >= jaccard.SIMILAR * len(s | t) - 1e-9:
                n_links[a] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, root(i), n) for (i, _), n in zip(sets, n_links) if i is not None)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "'x' as k1", "1 as n", "'y' as words", "2 as copies")


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed)))
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == classes(rows)


def test_jaccard_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    r = random.Random(3)
    base = words(r, 100)
    rows = []
    for k in range(30):
        text = list(base)
        text[r.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(text)))
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted((g.doc_id, g.class_id, g.n_links) for g in got) == classes(rows)


def test_many_short_near_copies(spark):
    """One group of thousands of short texts that all link: cells are bounded by sets, so no matrix grows with the group."""
    base = " ".join(f"w{k}" for k in range(40))
    df = spark.range(6000).selectExpr("id as doc_id", f"concat('{base} end', cast(id as string)) as text")
    got = jaccard.join(df).groupBy("class_id", "n_links").count().collect()
    assert [(g.class_id, g.n_links, g["count"]) for g in got] == [(0, 5999, 6000)]


def test_jaccard_odd_rows(spark):
    long = " ".join(f"u{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "other words"), (None, "one two"), (7, long), (8, long + " end")]
    got = jaccard.join(frame(spark, rows)).collect()
    assert len(got) == 9
    by = {(g.doc_id, g.class_id, g.n_links) for g in got}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (7, 7, 1), (8, 7, 1), (None, None, 0)} <= by
    assert jaccard.join(frame(spark, rows).where("doc_id = 99")).count() == 0


def stripped(rows):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - passages.WINDOW + 1):
            if i is not None:
                x = tuple(w[k : k + passages.WINDOW])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        x = split(t)
        gone = [False] * len(x)
        for k in range(len(x) - passages.WINDOW + 1):
            if i is not None and first[tuple(x[k : k + passages.WINDOW])] < i:
                gone[k : k + passages.WINDOW] = [True] * passages.WINDOW
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_passages_equal_all_windows(spark, seed):
    rows = list(enumerate(corpus(seed, 80)))
    got = sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in passages.dedup(frame(spark, rows)).collect()), key=str)
    assert got == stripped(rows) and any(g[2] for g in got)


def test_passages_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD", 40)
    monkeypatch.setattr(passages, "STRETCH", 64)
    monkeypatch.setattr(passages, "STREAM", 5)
    monkeypatch.setattr(passages, "BLOCK", 70)
    rows = list(enumerate(corpus(6, 60)))
    got = sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in passages.dedup(frame(spark, rows)).collect()), key=str)
    assert got == stripped(rows)


def test_passages_odd_rows(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, p), (4, p), (4, p), (None, p), (6, "é x " + p + " y"), (7, " ".join(["same"] * 200)), (8, p + " " + p), (9, "a " + p), (9, p + " b"), (9, " ".join(f"q{k}" for k in range(55))), (10, " ".join(f"q{k}" for k in range(60)))]
    got = sorted(((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in passages.dedup(frame(spark, rows)).collect()), key=str)
    assert got == stripped(rows)
    assert passages.dedup(frame(spark, rows).where("doc_id = 99")).count() == 0


def greedy(item, doc, seed):
    """String tiling as it is told: the longest match of unmarked words, the first in the document, then in the item."""
    a, b, marked = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (seed - 1, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return marked
        a[i : i + n] = b[j : j + n] = [True] * n
        marked += n


@pytest.mark.parametrize("seed", range(12))
def test_tiling_equals_plain(seed):
    r = random.Random(seed)
    item = words(r, r.randint(3, 30), 6)
    doc = words(r, r.randint(0, 40), 6) + item[5:15] + words(r, 4, 6) + item[:5]
    tile = min(decontaminate.TILE, len(item))
    got = decontaminate.tiled(decontaminate.words_of(" ".join(item)), decontaminate.words_of(" ".join(doc)), tile)
    want = greedy(item, doc, tile)
    assert got == want


def test_tiling_of_repeated_words_ends():
    same = decontaminate.words_of("same " * 20_000)
    assert decontaminate.tiled(same, same, 5) == 20_000
    assert decontaminate.tiled(same[:4000], same[:1500], 5) == 1500
    r = random.Random(1)
    pieces = [w for n in range(5, 120) for w in (*words(r, n, 3), f"x{n}")]
    turned = [w for n in reversed(range(5, 120)) for w in (*pieces[:n], f"y{n}")]
    assert decontaminate.tiled(decontaminate.words_of(" ".join(pieces)), decontaminate.words_of(" ".join(turned)), 5) > 100


@pytest.mark.parametrize("common", [False, True])
def test_decontamination(spark, common):
    """Against a plain tiling of all pairs; with `common`, most documents have a passage that is half of the third item's seeds."""
    r = random.Random(8)
    items = [words(r, 40, 5000) for _ in range(3)]
    turned = items[1][25:] + ["between"] + items[1][:25]
    docs = [(0, " ".join(words(r, 100, 5000))), (1, " ".join(["before", *items[0], "after"]).upper()), (2, " ".join(turned)), (3, " ".join(items[2][:15])), (4, None), (5, ""), (1, "w4000 w4000"), (None, " ".join(items[0]))]
    docs += [(k, " ".join(words(r, 30, 5000) + items[2][12:30] * common)) for k in range(6, 40)] + [(50, " ".join(items[2])), (50, " ".join(items[2]))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(7, None), (8, ""), (9, "w1"), (2, " ".join(items[2])), (None, " ".join(items[1]))], "item_id long, text string")
    want = []
    for d, text in docs:
        doc = split((text or "").lower())
        for i, t in [(r.item_id, split(r.text or "")) for r in bench.collect()]:
            share = greedy(t, doc, min(decontaminate.TILE, len(t))) / len(t) if t else 0
            if share >= decontaminate.COVER:
                want.append((d, i, share))
    df = frame(spark, docs).selectExpr("*", "'x' as item_id", "1 as key", "array(1) as leaks")
    got = [(g.doc_id, g.item_id, g.coverage) for g in decontaminate.leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    gone = [(d, t) for d, t in docs if any(w[0] == d for w in want) and t != "w4000 w4000"]
    left = [(g.doc_id, g.text) for g in decontaminate.clean(df, bench).select("doc_id", "text").collect()]
    assert sorted(left + gone, key=str) == sorted(docs, key=str) and decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


def test_a_document_with_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    r = random.Random(9)
    items = [words(r, 20, 5000) for _ in range(60)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = frame(spark, [(1, " ".join(w for x in items for w in x)), (2, " ".join(items[5]))])
    got = sorted((g.doc_id, g.item_id) for g in decontaminate.leaks(df, bench).collect())
    assert got == [(1, k) for k in range(60)] + [(2, 5)]


def mixed(rows, share=1.5, cap=2.0):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        more = {s for s in order if s not in capped and target[s] > cap * sizes[s] + 1e-9}
        if not more:
            return sizes, target
        capped |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "b", "é", "Z", None, "huge"]) if r.random() < 0.6 else "huge", " ".join(words(r, r.randint(0, 40)))) for k in range(300)] + [(None, "a", "x y"), (1000, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as weight", "3 as bucket")
    got = mixing.mix(df).collect()
    sizes, target = mixed(rows)
    source = {k: s for k, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == sizes[s] and abs(g.target - target[s]) < 1e-6 and 0 <= g.taken <= 2 * g.size
        taken[s] += g.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_documents_of_the_mix(spark):
    """with_repeats() against mix(), with copies of one id on a mark, and with columns of the same names."""
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", None]), " ".join(words(r, r.randint(0, 40)))) for k in range(200)] + [(7, "same", "one two three")] * 50 + [(None, "a", None), (None, "a", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' as taken", "1 as `order`")
    got = mixing.with_repeats(df)
    assert got.columns == ["doc_id", "source", "text", "order", *mixing.OWN]
    mine = sorted((str(g.doc_id), g.size, g.source_size, g.target, g.repeats, g.taken) for g in got.collect())
    assert mine == sorted((str(g.doc_id), g.size, g.source_size, g.target, g.repeats, g.taken) for g in mixing.mix(df).collect())
    assert sorted((g.doc_id, g.source, g.text) for g in got.where("doc_id is not null and source is not null").collect()) == sorted(x for x in rows if x[0] is not None and x[1] is not None)
    assert 0 < sum(g.repeats for g in got.where("source = 'same'").collect()) and mixing.with_repeats(df.limit(0)).count() == 0
