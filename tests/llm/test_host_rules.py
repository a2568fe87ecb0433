"""Host rules against plain Python, and the plan's main path without Python."""

import random

import pytest
from compare import oracle, rows

from lodestone.llm import host_rules as rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = "\t\n\v\f\r "


def words(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = {}, set()
    for x in windows:
        times[x] = times.get(x, 0) + 1
    for i, x in enumerate(windows):
        covered |= {i, i + 1, i + 2} if times[x] > 1 else set()
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(covered)}


def plain(docs):
    """doc_id -> (counts, base_failed, kept, host_rejected, host_watched) for each row, in order."""
    all_ = [(d, h, counts(t)) for d, t, _, h, _ in docs]
    fails = lambda rule, c: eval(rule, {}, c)  # noqa: E731, S307
    names = [r.name for r in rules.RULES] + ["failing"]
    hosts = {}
    for _, h, c in all_:
        own = [fails(r.lenient, c) for r in rules.RULES]
        at = hosts.setdefault(h, dict.fromkeys(["n", *names], 0))
        at["n"] += 1
        for name, f in zip(names, [*own, any(own)], strict=True):
            at[name] += f
    rate = {}
    for name in names:
        n, f = sum(x["n"] for x in hosts.values()), sum(x[name] for x in hosts.values())
        m = f / n
        spread = sum(x["n"] * (x[name] / x["n"] - m) ** 2 for x in hosts.values())
        room = m * (1 - m) * (n - sum(x["n"] ** 2 for x in hosts.values()) / n - (len(hosts) - 1))
        between = (spread - m * (1 - m) * (len(hosts) - 1)) / room if room > 0 else 0
        strength = min(rules.MOST_PRIOR, max(rules.LEAST_PRIOR, 1 / between - 1)) if between > 1e-12 else rules.MOST_PRIOR
        for h, x in hosts.items():
            rate[h, name] = (x[name] + m * strength) / (x["n"] + strength)
    out = []
    for d, h, c in all_:
        watched = [r for r in rules.RULES if r is not rules.BASE and rate[h, r.name] > rules.WATCH]
        rejected = rate[h, "failing"] > rules.REJECT
        failed = rejected or any(fails(r.lenient, c) for r in rules.RULES) or any(fails(r.strict, c) for r in watched)
        out.append((d, *c.values(), fails(rules.BASE.lenient, c), not failed, rejected, bool(watched)))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    docs = []

    def text(n, symbols=0.0, lines=8):
        w = ["".join(r.choice("abcdéß𝔘") for _ in range(r.randint(2, 9))) + ("##" if r.random() < symbols else "") for _ in range(n)]
        return "\n".join(r.choice([" ", "  ", "\t"]).join(w[k : k + lines]) for k in range(0, n, lines))

    for k in range(160):
        host = ["good", "junk", "rare", "hopeless", None][min(k % 7, 4) if k % 40 else 2]
        symbols = {"junk": r.choice([0.0, 0.1, 0.6]), "hopeless": 0.9, "rare": 0.9}.get(host, 0.0)
        docs.append((k, text(r.randint(51, 140), symbols), "en", host, k))
    docs += [(200, None, "en", "good", None), (201, "", None, "good", 0), (202, "a a a a", "en", "good", 7), (203, " \n \n\t\n", "en", None, 5), (204, "one\none\n" * 40, "en", "good", 9), (None, text(60), "en", "good", 1)]
    docs += [(205, "a b c d " * 30, "en", "good", 9), (206, text(3000) + "\n" + text(50) * 2, "en", "good", 9), docs[3], docs[3]]
    return docs


def test_rules(spark, tmp_path):
    docs = corpus()
    folder = str(tmp_path / "t")
    spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as n_words", "text as words", "true as rejected", "'k' as key", "lang as host").repartition(3).write.parquet(f"{folder}/documents.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in rules.judged(frame, frame["source"]).collect()]
    want = plain(docs)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({w[-2:] for w in want}) >= 3 and {w[-3] for w in want} == {True, False}, "hosts of each verdict"
    assert not any(w[-3] for w in want if w[-2]) and any(w[-1] and w[-3] for w in want)
    query = rules.query(spark, folder)
    assert query.columns[:8] == "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert rows(query.toPandas()) == rows(oracle_of(folder).df())


def oracle_of(folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con.sql(rules.HOST_SQL)


@pytest.mark.parametrize("docs", [[], corpus()[:1], corpus()[160:163]], ids=["none", "one", "short"])
def test_few(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA)
    got = [tuple(r) for r in rules.judged(frame, frame["source"]).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs) if docs else [], key=repr)


def test_no_python(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (rules.measured(frame, frame["source"]), rules.query(spark, sf_dir)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_prior():
    assert rules.prior(1, 10, 100.0, 5, 2.5) == (0.5, rules.MOST_PRIOR)
    assert rules.prior(0, 0, 0.0, 0, 0.0) == (0.0, rules.MOST_PRIOR)
    mean, strength = rules.prior(2, 200, 20000.0, 100, 100.0)  # one host fails always, one never
    assert mean == 0.5 and strength == rules.LEAST_PRIOR


def test_sql(spark, sf_dir):
    assert rows(rules.query(spark, sf_dir).toPandas()) == rows(oracle(sf_dir).sql(rules.HOST_SQL).df())
