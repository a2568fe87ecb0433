"""Main text on held-out pages, WARC round trips, quality on held-out labels."""

import random

import pytest

from lodestone.llm import html_text, mainpages, quality, warc


@pytest.fixture(scope="module")
def model():
    return html_text.TreeModel().train(mainpages.labelled_pages(html_text.PAGES))


def test_messages_equal_enumeration():
    import itertools

    import numpy as np

    page = html_text.read("<div class=menu><p>one<p>two words</div><article>text<ul><li>a<li>b</ul></article>")
    forest = html_text.Forest([page])
    m = html_text.TreeModel()
    r = np.random.default_rng(1)
    m.weights, m.pair = r.normal(size=m.weights.shape), r.normal(size=m.pair.shape)
    own, n = forest.features @ m.weights, len(page.parent)
    total = np.zeros(n)
    z = 0.0
    for y in itertools.product((0, 1), repeat=n):
        score = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(m.pair[forest.kind[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        z += score
        total += score * np.array(y)
    assert np.allclose(m.marginals(forest)[0], total / z)


def test_held_out_pages(model):
    right = chars = 0
    for seed in range(10_000, 10_060):
        source, labels = mainpages.Maker(seed).page()
        page = html_text.read(source)
        content = model.marginals(html_text.Forest([page]))[0] >= 0.5
        for (i, text, _), y in zip(page.blocks, labels, strict=True):
            right += len(text) * (bool(content[i]) == bool(y))
            chars += len(text)
    assert right / chars > 0.97


HAND_WRITTEN = (
    ("<html><body><p>one paragraph</p></body></html>", "one paragraph"),
    ("<article><p>Hi.</p></article>", "Hi."),
    ("just some text, &lt;without&gt; tags", "just some text, <without> tags"),
    ("<body>text<br>text</body>", "text text"),
    ("<article><h1>T</h1><p>Some words here. And more of them.</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>After it, more words.</p></article>", "T\nSome words here. And more of them.\na\nb\n1\n2\nAfter it, more words."),
    ("<article><p>Some words here.</p><figure><img src=x><figcaption>A picture of it</figcaption></figure></article>", "Some words here.\nA picture of it"),
    ("<main><details><summary>More</summary><p>Hidden words here.</p></details></main>", "More\nHidden words here."),
    ("<article><p>Before.</p><select><option>a<option>b<p>After the list. And more words.</p></article>", "Before.\nAfter the list. And more words."),
    ("<article><p>Before.</p><video src=x><p>After the film. And more.</p></article>", "Before.\nAfter the film. And more."),
    ("<article><p>Press <button>Share</button> to go on.</p></article>", "Press to go on."),
    ("<body><object><div>fallback</div></object><map name=x>In a map.</map><p>Rest of it</p></body>", "In a map.\nRest of it"),
    ("<p>a < b and b > c", "a < b and b > c"),
    ("<nav><a href=/>Home</a> <a href=/b>B</a></nav><article><p>Body text.</p></article><footer>&copy; X</footer>", "Body text."),
    ("<nav><ul><li><a href=/x>X</a></li></ul></nav>", ""),
    ("<div class=comments><p>I like this article a lot.</p></div>", ""),
    ("<a " * 350_000, ("<a " * 350_000).strip()),
)


@pytest.mark.parametrize("source,text", HAND_WRITTEN, ids=range(len(HAND_WRITTEN)))
def test_hand_written_pages(source, text, model):
    assert model.texts([source]) == [text]


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><h1>A &amp; B</h1><p>Text  with\n<b>bold</b> words. And more of it here, so that it is long.<p>Second.</article><script>var p='</p>'</script>"), (3, None, "plain"), (5, "u", "<article>" + "<p>Some words in a row here.</p>" * 3000 + "</article>"), (6, "u", "<<<>>&#xZ; </p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as n_chars")
    got = html_text.extract(df, model).collect()
    by = {(g.page_id, g.html or ""): g.text for g in got}
    assert len(got) == 6 and by[1, ""] == "" and by[2, ""] == ""
    assert next(v for k, v in by.items() if k[0] == 3 and "bold" in k[1]).startswith("A & B\nText with bold words.")
    assert next(v for k, v in by.items() if k[0] == 5).count("\n") == 2999
    assert by[3, "plain"] == "plain"
    assert html_text.extract(df.limit(0), model).count() == 0


def test_deep_nesting_takes_linear_time():
    """Hundred thousand open elements, as many end tags of others, and the same inside of what is hidden."""
    import time

    n, began = 100_000, time.perf_counter()
    for source in ("<div>" * n + "</xyz>" * n + "end", "<svg>" + "<g>" * n + "</xyz>" * n + "</svg>end", "<div><p>" * n + "</p></div>" * n + "end"):
        assert html_text.read(source).blocks[-1][1] == "end"
    assert time.perf_counter() - began < 30


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(warc.loser_tree([iter(x) for x in runs])) == sorted(sum(runs, []))


def test_archives(spark, tmp_path):
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k % 7}?b=1&a=2", None if k == 3 else f"<p>é {k % 13}\r\n\r\nx</p>" if k else "") for k in range(200)]
    rows += [(None, "u", "x"), (None, None, "<p>é 5\r\n\r\nx</p>"), (900, None, "last"), (901, "http://a.example/ sp ace\n", "last"), (7, "u", "another of this id"), (950, "u", "another of this id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as record_type")
    warc.write(warc.records(df), str(tmp_path / "w"), per_file=30)
    owner = {}
    for k, _, html in rows:
        owner[html or ""] = max(owner.get(html or "", -1), -1 if k is None else k)
    for per_range in (warc.RANGE, 10):
        index = warc.merged_index(spark, str(tmp_path / "w"), per_range).collect()
        keys = [(x.url_key, x.stamp, x.page_id is not None, x.page_id or 0) for x in index]
        assert keys == sorted(keys)
        got = sorted((x.page_id is not None, x.page_id or 0, x.payload_bytes, x.refers_to or -1, x.record_type) for x in index)
        want = []
        for k, _, html in rows:
            best = owner[html or ""]
            refers = best if best >= 0 and best != k else -1
            want.append((k is not None, k or 0, len((html or "").encode()), refers, "response" if refers < 0 else "revisit"))
        assert got == sorted(want)
    assert len(warc.archive(df.limit(0), str(tmp_path / "e")).collect()) == 0


def test_large_pages_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    df = spark.range(12).selectExpr("id as page_id", "'u' as url", "repeat(concat(cast(id as string), ' text '), 8000) as html")
    index = warc.archive(df, str(tmp_path / "big")).collect()
    assert len(index) == 12 and len({x.run for x in index}) >= 6 and all(x.record_type == "response" for x in index)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbb"), (4, "u", "bbbbb")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.records(df, least=3).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_quality_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs.join(labels, "doc_id").where(quality.held_out()), model).select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_votes_equal_plain_votes(spark):
    """Scores against plain cosines and a plain vote, with ties and an id that has two texts."""
    import math

    import numpy as np

    r = random.Random(4)
    texts = [" ".join(r.choice(("good", "words", "here", "some", "RATHER", "$$", "42")) for _ in range(r.randint(1, 30))) for _ in range(150)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, "another text"), (4, texts[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int"))
    held = spark.range(150).selectExpr("id as doc_id").select("doc_id", quality.held_out().alias("h")).where("not h").count()
    assert len(model.labels) == held + 1
    assert len(quality.fit(df, spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int"), most=20).labels) == 20
    vectors = model.vectors.astype(float).tolist()
    queries = [*texts, "a few new words", "good " * 40]
    for text, got in zip(queries, model.scores(queries)):
        v = model.placed(quality.terms(text)[None], [quality.words_of(text)])[0].astype(float).tolist()
        cosines = [sum(a * b for a, b in zip(v, w)) for w in vectors]
        plain = []
        for error in (0, 1.1e-5, -1.1e-5):  # of the fifth digit: it decides which are as near as the last
            least = sorted(cosines)[-quality.NEIGHBOURS] - error
            votes = [(max(c, 0) ** 4 + 1e-9, y) for c, y in zip(cosines, model.labels) if c >= least]
            plain.append(sum(w * y for w, y in votes) / sum(w for w, _ in votes) if votes else 0)
        assert any(math.isclose(got, p, abs_tol=1e-4) for p in plain), (got, plain)
    assert np.array_equal(model.scores(queries[:7]), model.scores(queries)[:7])


def test_words_alone_tell_texts_apart(spark):
    """Two kinds of texts of words of the same form, which byte classes can't tell apart."""
    r = random.Random(5)
    kinds = ("karo pelu mino sadi vetu".split(), "lamo terk buni dosa hufi".split())
    docs = [(k, " ".join(r.choice(kinds[k % 2]) for _ in range(30))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, quality int"))
    held = quality.score(df, model).where(quality.held_out()).collect()
    assert len(held) > 30 and all((g.score > 0.5) == (g.doc_id % 2 == 1) for g in held)


def test_quality_odd_rows(spark):
    r = random.Random(1)
    docs = [(k, " ".join("good words here and there.".split() * r.randint(1, 9)) if k % 2 else "$$ %% 99 " * r.randint(1, 9)) for k in range(60)]
    df = spark.createDataFrame([*docs, (100, None), (101, ""), (None, "x"), (101, "y " * 50_000)], "doc_id long, text string").selectExpr("*", "'x' as label", "0.5 as v")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels)).collect()
    assert len(got) == 64 and all(0 <= g.score <= 1 for g in got)
    right = [g.predicted == g.doc_id % 2 for g in got if g.doc_id is not None and g.doc_id < 60]
    assert sum(right) >= 57
    none = quality.score(df, quality.fit(df, labels.limit(0))).select("score").distinct().collect()
    assert [g.score for g in none] == [0.5]
    assert quality.score(df.limit(0), quality.fit(df, labels)).count() == 0
