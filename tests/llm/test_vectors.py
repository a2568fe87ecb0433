"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from lodestone.llm import cells, common, vectors


def brute(rows):
    good = {}
    for k, (vec, v, label) in enumerate(rows):
        if vec is not None and label is not None and v is not None and len(v) and None not in v:
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                good[k] = (vec, x / np.linalg.norm(x), label)
    links = {k: 0 for k in range(len(rows))}
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a != b and good[a][2] == good[b][2] and good[a][1] @ good[b][1] >= vectors.SIMILAR:
                links[a] += 1
                x, y = root(good[a][0]), root(good[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0], links[k], root(r[0])) for k, r in enumerate(rows))


def test_all_links(spark):
    r = np.random.default_rng(1)
    rows, vec = [], 0
    for c in range(60):
        centre = r.normal(size=64)
        for _ in range(int(r.integers(1, 9))):
            rows.append((vec, (centre + r.normal(size=64) * r.choice([0.05, 0.2, 0.27])).astype(np.float32).tolist(), int(c % 3)))
            vec += 1
    rows += [(vec, rows[0][1], rows[0][2]), (vec + 1, rows[0][1], None), (vec + 2, None, 1), (vec + 3, [0.0] * 64, 1), (vec + 4, [float("nan")] + [1.0] * 63, 1), (vec + 5, [None] + [1.0] * 63, 1), (vec + 6, [float("inf")] + [1.0] * 63, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.near(df).collect()
    want = brute(rows)
    missed = sum(w[1] for w in want) - sum(g.n_links for g in got)
    assert 0 <= missed <= 0.01 * sum(w[1] for w in want)
    if not missed:
        assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == want
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)


def test_a_large_bucket_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)
    r = np.random.default_rng(2)
    centre = r.normal(size=64)
    rows = [(k, (centre + r.normal(size=64) * 0.1).tolist(), 0) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in vectors.near(df).collect()) == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int").selectExpr("*", "9 as links", "'x' as component_id")
    got = sorted(((g.vec_id or -1), g.n_links) for g in vectors.near(df).collect())
    assert [g[0] for g in got] == [-1, 1, 1, 2]
    assert vectors.near(df.where("vec_id = 77")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(20)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {g.node: g.component for g in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_whole_keys():
    import pandas as pd

    keys = [1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 8):
        batches = [pd.DataFrame({"k": keys[a : a + size]}) for a in range(0, 8, size)]
        out = [p.k.tolist() for p in cells.whole_keys(iter(batches), "k")]
        assert sum(out, []) == keys and all(x[-1] != y[0] for x, y in zip(out, out[1:]))


def test_lone_pairs_at_the_threshold_share_a_filter():
    r = np.random.default_rng(11)
    one, other = vectors.unit(r.normal(size=(3000, 64))), r.normal(size=(3000, 64))
    other = vectors.unit(other - (one * other).sum(1, keepdims=True) * one)
    two = vectors.SIMILAR * one + np.sqrt(1 - vectors.SIMILAR**2) * other
    codes = [vectors.Filters(64, vectors.SEED + k) for k in range(vectors.CODES)]
    missed = sum(not np.intersect1d(a, b).size for a, b in zip(vectors.all_lists(codes, one), vectors.all_lists(codes, two)))
    missed_by_one = sum(not np.intersect1d(a, b).size for a, b in zip(codes[0].lists(one), codes[0].lists(two)))
    print(f"recall of lone pairs at {vectors.SIMILAR}: {1 - missed / 3000:.4f}; by one code {1 - missed_by_one / 3000:.4f}")
    assert missed <= 1 and missed <= missed_by_one, (missed, missed_by_one)


def test_larger_codes_keep_the_load_and_the_recall():
    """For a hundred million vectors of a label: as many filters a vector, and pairs at the threshold still share one."""
    assert vectors.code_size(1000) == vectors.CODE and vectors.code_size(10**8) == 2191
    r = np.random.default_rng(13)
    one, other = vectors.unit(r.normal(size=(400, 64))), r.normal(size=(400, 64))
    other = vectors.unit(other - (one * other).sum(1, keepdims=True) * one)
    two = vectors.SIMILAR * one + np.sqrt(1 - vectors.SIMILAR**2) * other
    codes = [vectors.Filters(64, vectors.SEED + k, 2191) for k in range(vectors.CODES)]
    lists = vectors.all_lists(codes, one), vectors.all_lists(codes, two)
    recall = np.mean([np.intersect1d(a, b).size > 0 for a, b in zip(*lists)])
    print(f"recall {recall:.4f}, {np.mean([len(x) for x in lists[0]]) / vectors.CODES:.1f} filters by code")
    assert recall >= 0.99 and np.mean([len(x) for x in lists[0]]) < 3 * vectors.PASSED * vectors.CODES


def test_rounded_products_keep_all_links():
    r = np.random.default_rng(14)
    rows = vectors.unit(np.vstack([r.normal(size=(200, 30)), r.normal(size=(200, 30)) * np.where(np.arange(30) == 3, 50, 0.2)]))
    held, scale, error = vectors.in_bytes(rows)
    rough = held * scale[:, None]
    assert (np.abs(rough @ rough.T - rows @ rows.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :]).all()


def test_vectors_of_every_length_link(spark):
    r = np.random.default_rng(12)
    rows = []
    for size in (64, 3, 1, 32, 32):
        centre = r.normal(size=size)
        rows += [(len(rows) + k, (centre * r.uniform(0.9, 1.1) + 0.01 * r.normal(size=size)).tolist(), 0) for k in range(4)]
    want = []
    for size in (64, 3, 1, 32):
        want += brute([x for x in rows if len(x[1]) == size])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in vectors.near(df).collect()) == sorted(want)
