import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import asof, chunks, htmltags, keep, linkify, links, merge, retrieval, rolling, slugs, threads, wordcloud
from lodestone.operators.pages import capped
from lodestone.plans import resolve


def test_longest_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0, "xx"), ("a", 1, "yy"), ("a", 2, "z"), ("b", 3, None), ("b", 4, "")], "k string, seq int, t string")
    assert {tuple(r) for r in keep.longest(df, ["k"], "t", "seq").select("k", "seq").collect()} == {("a", 0), ("b", 4)}


def test_mode_prefers_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, ""), (6, None)], "seq int, v string")
    assert keep.mode(df, "v", "seq").first() == ("b", 2)


def test_numbered(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1), ("x", 3)], "k string, seq int")
    assert sorted(r.id for r in keep.numbered(df, "k", ["seq"], "id").collect()) == ["x", "x_2", "x_3", "y"]


def test_slugs_equal_one_by_one(spark):
    r = random.Random(5)
    bases = [r.choice(["a", "a-2", "a-2-2", "a-3", "b", "b-c", "b-10"]) for _ in range(60)]
    taken, want = set(), {}
    for k, base in enumerate(bases):
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        want[k] = slug
    df = spark.createDataFrame(list(enumerate(bases)), "id bigint, base string")
    assert {x.id: x.slug for x in slugs.unique(df, "base", ["id"]).collect()} == want


@pytest.mark.parametrize("strict", [True, False])
def test_asof_equals_a_scan(spark, strict):
    r = random.Random(3)
    rows = [(k, r.choice("uv"), r.randrange(400)) for k in range(80)]
    others = [(k, r.choice("uv"), r.randrange(400)) for k in range(40)]
    want = {}
    for k, u, at in rows:
        near = [(t, j) for j, v, t in others if v == u and (t < at if strict else t <= at)]
        want[k] = max(near)[1] if near and at - max(near)[0] <= 50 else None
    left = spark.createDataFrame(rows, "id int, u string, at long")
    right = spark.createDataFrame(others, "oid int, u string, at long").withColumn("found", F.col("oid"))
    got = asof.latest_before(left, right, "u", "at", "oid", ["found"], 50, strict)
    assert {x.id: x.found for x in got.collect()} == want


def test_trailing_counts_equal_a_scan(spark):
    r = random.Random(1)
    rows = [(k, r.choice("uv"), r.randrange(1000)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, u string, at long")
    for keys in (["u"], []):
        want = {k: sum(1 for _, v, t in rows if (not keys or v == u) and at - 100 <= t <= at) - 1 for k, u, at in rows}
        assert {x.id: x.n for x in rolling.trailing_counts(df, "id", "at", 100, 30, keys).collect()} == want


def test_admitted_equals_one_by_one(spark):
    r = random.Random(2)
    rows = [(k, r.choice([1, 2]), r.randrange(300)) for k in range(150)]
    want, recent = {}, {1: [], 2: []}
    for k, u, at in sorted(rows, key=lambda x: (x[2], x[0])):
        recent[u] = [t for t in recent[u] if t >= at - 40]
        want[k] = len(recent[u]) < 3
        if want[k]:
            recent[u].append(at)
    df = spark.createDataFrame(rows, "id long, u long, at long")
    assert {x.event_id: x.admitted for x in rolling.admitted(df, "id", "u", "at", 3, 40).collect()} == want


@pytest.mark.parametrize("top", [10, 12, 50])
def test_across_years_equals_greedy(spark, top):
    r = random.Random(4)
    for _ in range(2):
        hits = [(k, r.choice([2019, 2020, 2021, None]), round(r.random(), 3), k) for k in range(70)]
        pool, picked, years = sorted(hits, key=lambda h: (-h[2], h[3])), [], {}
        while pool and len(picked) < top:
            best = max(pool, key=lambda h: (round(h[2] - 0.1 * (years.get(h[1], 0) if h[1] else 0) * h[2], 9), h[2], -h[3]))
            pool.remove(best)
            picked.append(best[0])
            years[best[1]] = years.get(best[1], 0) + 1
        df = spark.createDataFrame(hits, "id int, y int, score double, pos int").withColumn("created_at", F.make_date("y", F.lit(1), F.lit(1)))
        got = retrieval.across_years(df, top).orderBy("place").collect()
        assert [x.id for x in got] == picked


def test_nearest_batch_in_blocks(spark):
    r = random.Random(6)
    vectors = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(60, None), (61, [0.0] * 8)]
    every = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = every.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    whole = retrieval.nearest_batch(queries, every, 5).orderBy("query_id", "rank").collect()
    assert retrieval.nearest_batch(queries, every, 5, block=3).orderBy("query_id", "rank").collect() == whole
    assert len(whole) == 35


def test_fusion(spark):
    hit = lambda rows: spark.createDataFrame(rows, "id int, created_at timestamp_ntz, reshared_from_author string, rank int, n int")
    words, vectors, dated = hit([(1, None, "", 1, 2), (2, None, "x", 2, 2)]), hit([(2, None, "x", 1, 1)]), hit([(3, None, "", 1, 1)])
    got = {r.id: r.score for r in retrieval.fuse(words, vectors, dated).collect()}
    assert got == {1: 0.5, 2: round((0.25 + 0.5) * 0.95, 9), 3: 0.85}


def test_cloud_drops_rare_pairs(spark):
    df = spark.createDataFrame([("alpha beta " * 6 + "https://x.example/gamma delta",)], "content_text string")
    got = {r.term: r.n for r in wordcloud.cloud(df).collect()}
    assert got["alpha beta"] == 6 and got["alpha"] == 6 and "beta delta" not in got and "gamma" not in got and got["delta"] == 1
    assert {r.term for r in wordcloud.cloud(df, lemma={"alpha": "omega"}).collect()} >= {"omega", "omega beta"}


def test_chunks_cover_the_text():
    text = "\n\n".join(" ".join(f"Word{k} is here." for k in range(n, n + 60)) for n in range(0, 400, 60))
    found = chunks.chunks_of(text)
    assert all(len(c) <= 800 for c in found) and found[0].startswith("Word0") and found[-1].endswith("here.")
    at = 0
    for c in found:
        here = text.index(c[:40], max(0, at - 200))
        assert here <= at + 2
        at = here + len(c)
    assert chunks.chunks_of("  ") == [] and chunks.chunks_of(None) == [] and chunks.chunks_of("x" * 2000)[1][:5] == "xxxxx"


def test_embed_inputs(spark):
    df = spark.createDataFrame([(1, "T", "a" * 900, ""), (2, "T", "", ""), (3, "", "b", "c"), (4, "", None, None)], "id long, t string, b string, r string")
    got = {(x.id, x.chunk_index): x.text for x in chunks.embed_inputs(df, "t", "b", "r").collect()}
    assert got[1, 0].startswith("T\n\naaa") and got[1, 1].startswith("aaa") and got[2, 0] == "T" and got[3, 0] == "b\n\nc" and not any(k[0] == 4 for k in got)


def test_tree_survives_bad_markup():
    root = htmltags.tree("<div class='a b'><p>one<p>two<b>x</i></b><script>var s='</p>';</script></div><img src=i.png>&amp;")
    assert root.first("div", "b").text() == "one two x"
    assert root.first("img").attrs["src"] == "i.png" and root.text() == "one two x &"
    assert htmltags.page_card("<title>T</title><meta property='og:title' content='O'><meta name=description content=D>")["title"] == "O"


def test_titles_keep_references_that_are_cut_off(spark):
    pages = ["<TITLE> a &amp; b &amp</title>", "<title>&amp;lt; &lt;i&gt;\n&quot;&#39;&eacute;</title><title>2</title>", "<title></title>", "<p>none", None]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", htmltags.page_title(F.col("html")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["a & b &amp", "&lt; <i>\n\"'&eacute;", "", "", None]


def test_a_prefix_of_many_names_makes_no_pairs(spark):
    urls = spark.createDataFrame([(k, f"https://h.example/u/{k}") for k in range(2000)], "k int, url string").repartition(4)
    names = spark.createDataFrame([("https://h.example/u", f"n{k:04d}") for k in range(2000)] + [("https://h.example/u/7", "own")], "p string, name string")
    found = links.named_by_prefix(urls, "url", names, "p", "name", "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.name for r in found.collect()} == {k: "own" if k == 7 else "n0000" for k in range(2000)}
    join = plan[plan.index("Join") :]
    assert "min(struct(name" in join, "names are cut down to one of each prefix below the join"


def test_networks_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(threads, "BLOCK", 16)
    r = random.Random(6)
    rows = [(k, k % 3 if k % 17 else None, r.choice([1000, 1000, r.randrange(5000)]) if k % 19 else None, [r.gauss(0, 1) for _ in range(5)]) for k in range(200)]
    rows += [(k, k % 3, 1000, v) for k, v in enumerate([None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, 2.0], [2.0, 4.1], [3.0, 6.0], [-1.0, 1.0]], 900)]
    found = threads.across_networks(spark.createDataFrame(rows, "id long, source int, at long, embedding array<double>"), 900, 0.4)
    got = {(x.a, x.b): x.distance for x in found.collect()}
    ok = [x for x in rows if x[1] is not None and x[2] is not None and x[3] and None not in x[3] and any(x[3]) and x[3][0] == x[3][0]]
    dot = lambda v, w: sum(x * y for x, y in zip(v, w))
    want = {}
    for a, s, t, v in ok:
        for b, o, u, w in ok:
            if s != o and (t, a) < (u, b) and u - t <= 900 and len(v) == len(w):
                distance = round(1 - dot(v, w) / (dot(v, v) ** 0.5 * dot(w, w) ** 0.5), 9)
                if distance <= 0.4:
                    want[a, b] = pytest.approx(distance, abs=2e-9)
    assert got == want and len(want) > 50
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString(), "pairs of blocks are joined, not pairs of posts"


OUT = 'target="_blank" rel="noopener noreferrer"'


def test_linkify():
    names = {"Max": "/max", "Max Muster": "/mm", "Nobody": ""}
    got = linkify.linked("Max Muster & <b> https://x.example/a?b=1&c=2. Maximal @you Nobody", names, linkify.pattern(names))
    assert got == f'<a href="/mm" {OUT}>Max Muster</a> &amp; &lt;b&gt; <a href="https://x.example/a?b=1&amp;c=2" {OUT}>https://x.example/a?b=1&amp;c=2</a> <a href="/max" {OUT}>Max</a>imal @you Nobody'
    assert linkify.linked("'https://x.example/a(b)!?'\">, <i>", {}, linkify.pattern({})) == f'&#x27;<a href="https://x.example/a(b" {OUT}>https://x.example/a(b</a> &lt;i&gt;'
    assert linkify.linked(None, {}, linkify.pattern({})) == ""


def test_linkify_messages():
    assert linkify.linked_message("@you_1 #Tag #тег_2, ünd@x\nhttps://x.example/\n\nlong/path, end") == (
        f'<a href="https://x.com/you_1" {OUT}>@you_1</a> <a href="https://x.com/search?q=%23Tag" {OUT}>#Tag</a> <a href="https://x.com/search?q=%23%D1%82%D0%B5%D0%B3_2" {OUT}>#тег_2</a>, ünd<a href="https://x.com/x" {OUT}>@x</a>\n'
        f'<a href="https://x.example/long/path" {OUT}>https://x.example/long/path</a> end'
    )
    assert linkify.linked_message("#é @é <3") == "#é @é &lt;3" and linkify.linked_message(None) == ""


def test_caps(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)] + [(99, None)], "id int, kind string")
    got = capped(df, "kind", [F.asc("id")], {"a": 3})
    assert sorted(x.id for x in got.collect()) == sorted([0, 2, 4, *range(1, 20, 2), 99])


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "", 3, 0), (1, "z", 9, 1), (3, "c", 0, 0)], "k int, v string, n int, seq int")
    got = merge.update_fields(old, new, ["k"], "seq", [], ["v"], ["n"])
    assert {tuple(r) for r in got.collect()} == {(1, "z", 9), (2, "b", 1)}
    assert {tuple(r) for r in merge.upsert(old, new, ["k"], "seq").collect()} == {(1, "z", 9), (2, "b", 1), (3, "c", 0)}
    filled = merge.fill_empty(spark.createDataFrame([(1, ""), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string"), ["k"], ["v"])
    assert {tuple(r) for r in filled.collect()} == {(1, "new"), (2, "x")}


def test_guarded_whitelist(spark):
    entries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "o int, p string")
    allowed = spark.createDataFrame([(1, "a")], "o int, p string")
    assert {tuple(r) for r in links.guarded_whitelist(entries, allowed, "o", "p", F.lit(False)).collect()} == {(1, "a"), (2, "c"), (2, "d")}


def test_reshare_states(spark):
    rows = [
        ("p", 0, False, True, "me", "", "", "t0"), ("own1", 1, True, True, "me", "w", "", "same"), ("own2", 2, True, True, "me", "w", "", "same"), ("oth1", 3, True, False, "you", "", "", "same"), ("oth2", 4, True, False, "she", "", "", "same"),
        ("bare", 5, True, True, "me", "", "", "x"), ("target", 6, True, True, "me", "", "u", "y"), ("words", 7, True, True, "me", "w", "", "z"), ("none", 8, True, False, "", "", "", "q"),
    ]
    df = spark.createDataFrame(rows, "id string, seq int, reshare boolean, own boolean, segment string, commentary string, target string, text string")
    got = {r.id: (r.state, r.other_id) for r in links.reshare_states(df).collect()}
    assert got == {"p": (1, None), "own1": (4, "oth2"), "own2": (3, None), "oth1": (7, None), "oth2": (9, None), "bare": (2, None), "target": (5, None), "words": (6, None), "none": (8, None)}


def put_posts(spark, folder, texts):
    """Documents 1.. with `texts`, all ordered on one day."""
    docs = spark.createDataFrame([(k, t, "en", "src1", len(t)) for k, t in enumerate(texts, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.sql("select 1L as doc_id, 1 as quality, 0 as toxic").write.parquet(f"{folder}/labels.parquet")
    docs.select(F.col("doc_id").alias("o_orderkey"), F.lit("2024-01-05").cast("timestamp").alias("o_orderdate")).where("o_orderkey <> 3").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_reshare_pairs_by_whole_texts(spark, tmp_path):
    """2 is own and 5 and 1 are another's: only 5 has the text of 2 and not just its beginning. 3 is no reshare, 4 own."""
    sf = put_posts(spark, tmp_path, ["The same twelve, then not", "The same twelve and the rest", "x", "The same twelve, alone", "The same twelve and the rest", "x", "The same twelve, last"])
    got = {r.id: (r.state, r.other_id) for r in resolve.reshare_text_pairs(spark, sf).collect()}
    assert got == {1: (8, None), 2: (4, 5), 3: (1, None), 4: (6, None), 5: (9, None), 6: (1, None), 7: (7, None)}


def test_slug_collisions_of_whole_slugs(spark, tmp_path):
    """Slugs of the date and eight words; 3 has no date, and 7 ends in a number."""
    sf = put_posts(spark, tmp_path, ["Same words here", "Same words here", "Same words here", "Salt", "Да", "Нет", "Same words here", "Same words here"])
    got = {r.id: r.slug.removeprefix("2024-01-05") for r in resolve.slug_collisions(spark, sf).collect()}
    assert got == {1: "-same-words-here", 2: "-same-words-here-2", 3: "0000-00-00-same-words-here", 4: "-salt", 5: "", 6: "-2", 7: "-same-words-here-2-2", 8: "-same-words-here-3"}


@pytest.mark.parametrize("preserve, want", [(False, [("a", "1", "new", ""), ("a", "3", "x", ""), ("b", "1", "kept", "mine")]), (True, [("a", "1", "new", "mine"), ("a", "2", "old", ""), ("a", "3", "x", ""), ("b", "1", "kept", "mine")])])
def test_reimport(spark, preserve, want):
    """Wiped, only other sources' rows stay; preserved, an edited note stays and the text is renewed."""
    shape = "source string, source_id string, text string, note string"
    old = spark.createDataFrame([("a", "1", "old", "mine"), ("a", "2", "old", ""), ("b", "1", "kept", "mine")], shape)
    new = spark.createDataFrame([("a", "1", "new", "", 0), ("a", "3", "x", "", 1)], f"{shape}, seq int")
    assert sorted(map(tuple, merge.reimport(old, new, "a", "seq", preserve, overwrite=("text",), fill=("note",)).collect())) == want
