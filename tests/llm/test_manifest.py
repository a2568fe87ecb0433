"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from compare import rows

from lodestone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes):
    """The root of `nodes`, and for each the pairs of what stands left and right of it, level by level."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            lo = at[k] // 8 * 8
            way.append(("".join(nodes[lo : at[k]]), "".join(nodes[at[k] + 1 : lo + 8])))
            at[k] //= 8
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], ways


def plain(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in keys:
        groups[lang].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        trees[lang] = climb([leaf(row) for row in groups[lang]])
    root, over = climb([trees[lang][0] for lang in keys]) if keys else (None, [])
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    out = []
    for lang, above in zip(keys, over, strict=True):
        subroot, ways = trees[lang]
        for row, way in zip(groups[lang], ways, strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf((row[0], row[1] and row[1].translate(low), *row[2:])) if hit else leaf(row)
            for left, right in way + above:
                fold = sha(left, fold, right)
            out.append((row[0], leaf(row), subroot, root, sha(*(a + b for a, b in way + above)), fold, fold == root))
    return out


def corpus(n=700):
    docs = [(k, f"Text {k}\nÄÖ {'x' * (k % 50)}", ["en", "en", "en", "fr", "Ünk", "", None][k % 7], f"src{k % 3}", k * 7) for k in range(n)]
    docs += [(n, None, "one", None, None), (n + 1, "", "one", "s", 0), (None, "No ID", "en", "s", 1), (None, None, None, None, None)]
    return docs + [docs[3], docs[3], (docs[4][0], "Another text of this id", *docs[4][2:])] + [docs[10]] * 20


@pytest.mark.parametrize("docs", [corpus(), corpus(8)[:1], corpus(9)[:9], [], [(k, "A", "en", "s", 1) for k in range(65)]], ids=["all", "one", "nine", "none", "65"])
def test_manifest(spark, tmp_path, docs):
    folder = str(tmp_path / "t")
    spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as grp", "text as leaf", "0 as pos", "'x' as proof").repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = merkle.query(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs), key=repr)


def test_written_levels_and_differences(spark, tmp_path):
    def manifest(docs, name):
        return merkle.build(merkle.documents(spark.createDataFrame(docs, SCHEMA)), [merkle.ORDER], str(tmp_path / name))

    docs = [(k, f"text {k}", ["en", "fr"][k % 5 == 0], "s", 1) for k in range(300)]
    old = manifest(docs, "old")
    assert [level.count() for level in old.groups] == [300, 30 + 8, 4 + 1, 1] and len(list((tmp_path / "old").iterdir())) == 4 + 2
    assert not merkle.differing(old, manifest(docs, "same")).count()
    docs[7] = (7, "changed", "en", "s", 1)
    assert [tuple(r) for r in merkle.differing(old, manifest(docs, "new")).collect()] == [("=en", 5)]
    longer = manifest([*docs, *[(k, "more", "fr", "s", 1) for k in range(300, 310)]], "longer")
    assert {tuple(r) for r in merkle.differing(old, longer).collect()} == {("=en", 5), *[("=fr", 60 + k) for k in range(10)]}


def test_sql(spark, sf_dir):
    from compare import oracle

    assert rows(merkle.query(spark, sf_dir).toPandas()) == rows(oracle(sf_dir).sql(merkle.MERKLE_SQL).df())
