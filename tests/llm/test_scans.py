"""Secrets and personal data against plain regular expressions; the tagger on held-out windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import pii, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in KEY.finditer(text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 24])


def plain_pii(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(n if k % 2 == 0 else n * 2 - 9 * (n > 4) for k, n in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15])


def scrambled(pieces, seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_secrets_equal_regular_expressions():
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "api", "key", "=", ":", " ", '"', "'", "a", "Z", "0", "AKIA", "AKIAABCDEFGH", "deadbeef", "0123456789abcdef", "é", "😀", "\n", "-", "_", ".", "/", "+", "x9Q"]
    for text in scrambled(pieces, 1, 3000):
        assert [s for s in secrets.spans(text) if s[1] < secrets.BASE] == plain_secrets(text), text


@pytest.mark.parametrize("text", ["ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJlMTIzNDU2Nzg5MDEyMzQ1Njc4", "-----BEGIN RSA PRIVATE KEY-----"])
def test_further_secrets(text):
    found = secrets.spans(f"é {text} end")
    assert any(k >= secrets.BASE and (a, b) == (2, 2 + len(text)) for a, k, b in found)


def test_further_rules_equal_regular_expressions():
    pieces = ["ghp_", "gho_", "xoxb-", "xoxp", "eyJ", "eyJabcdefghijklmnop", ".", "A1b2C3d4e5", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "_", " ", "é", "token="]
    for text in scrambled(pieces, 3, 3000):
        plain = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(secrets.RULES) if k >= secrets.BASE for m in re.finditer(p.decode(), text) if len(m.group()) >= least]
        assert [s for s in secrets.spans(text) if s[1] >= secrets.BASE] == sorted(plain), text


def test_automaton_is_minimal_and_exact():
    auto = secrets.compiled((b"ab+c", b"(a|b)c"))
    assert [(at, rules) for at, rules in secrets.ends(b"abbc bc ac", auto)] == [(3, (0, 1)), (6, (1,)), (9, (1,))]
    assert len(secrets.compiled((b"abc", b"abc")).arrays) == 4


def test_secrets_in_long_texts():
    """Each of these took time or memory out of proportion when matches were looked at one by one."""
    assert secrets.spans("a0" * 500_000) == [(0, 2, 1_000_000)]
    many = secrets.spans("é token=abcdefgh " * 40_000)
    assert len(many) == 40_000 and many[-1] == (17 * 39_999 + 2, 0, 17 * 40_000 - 1)
    rejected = "token=xtoken: " + "z" * 500_000
    assert secrets.spans(rejected) == plain_secrets(rejected)
    assert len(secrets.spans("eyJab." * 100_000)) == 0
    assert secrets.spans(None) == secrets.spans("") == []


def test_pii_rules_equal_regular_expressions():
    pieces = ["ann", "@", ".", "x", "-", "+", "%", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+49 ", "(30)", " ", "127.0.0.1", "é", "😀", "\n", "0"]
    for text in scrambled(pieces, 2, 3000):
        assert pii.base_spans(text) == plain_pii(text), text


def test_masking():
    text = "Mail ann@x.org, 127.0.0.1 end"
    assert pii.masked(text, pii.base_spans(text)) == "Mail <EMAIL>, <IP> end"


@pytest.fixture(scope="module")
def tagger(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 130, (2, 7)).astype(np.uint8), r.integers(0, 5, (2, 7)).astype(np.uint8)
    model = pii.Tagger(3)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64) * 0.3

    def loss():
        e = (model.states(ids).astype(np.float64) @ model.p["o"] + model.p["b"]).astype(np.float64)
        up, score = e[0], e[0, np.arange(2), tags[:, 0]]
        for k in range(1, 7):
            up = pii.logsum(up[:, :, None] + model.p["a"], 1) + e[k]
            score = score + model.p["a"][tags[:, k - 1], tags[:, k]] + e[k, np.arange(2), tags[:, k]]
        return float((pii.logsum(up, 1) - score).mean())

    grad = model.gradients(ids, tags)
    for key, at in (("o", (3, 1)), ("b", (2,)), ("a", (1, 2)), ("u", (0, 2, 5)), ("x", (1, int(ids[0, 3]), 4))):
        keep = model.p[key][at]
        model.p[key][at] = keep + 1e-3
        high = loss()
        model.p[key][at] = keep - 1e-3
        low = loss()
        model.p[key][at] = keep
        assert abs((high - low) / 2e-3 - grad[key][at]) < 2e-3


def test_tagger_finds_held_out_mail(tagger):
    """Recall by the model alone on texts that it hasn't seen, over windows' borders too."""
    r = random.Random(9)
    texts, want = [], 0
    for k in range(60):
        mail = "".join(r.choice("abcdefghijklm") for _ in range(8)) + str(k) + "@example.com"
        texts.append("word " * r.randint(1, 90) + f"write to {mail} now " + "and so on " * r.randint(1, 50))
    found = tagger.decode(texts)
    for text, spans in zip(texts, found):
        a, _, b = pii.base_spans(text)[0]
        want += any(k == 0 and s < b and a < e for s, k, e in spans)
    assert want >= 45


def best_path(model, text):
    """The CRF's best path over a whole text, character by character, with no short cut."""
    e = np.tile(np.array([0.0] + [-1e4] * len(pii.KINDS)), (len(text) + 2, 1))
    for low, high in pii.surroundings(text):
        cut = pii.windows(pii.symbols(text[low:high]))
        got = model.emissions(cut)
        for at in range(high - low):
            w = min(max((at - pii.MARGIN) // pii.STRIDE, 0), len(cut) - 1)
            e[low + at + 1] = got[w, at - w * pii.STRIDE]
    a, score, back = model.p["a"], e[0], []
    for row in e[1:]:
        all_ = score[:, None] + a
        back.append(all_.argmax(0))
        score = all_.max(0) + row
    path = [int(score.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return path[::-1][1:-1]


@pytest.mark.parametrize("batch", [1, 2, 2048])
def test_decoding_equals_one_best_path(tagger, monkeypatch, batch):
    """Slices of one, two and many windows, with pieces over their borders, against the best path of the whole text."""
    monkeypatch.setattr(pii, "BATCH", batch)
    texts = ["so it is " * 40 + "ann.lee@example.com" + " and that" * 40, "", "x", "1 2 3 . 4 @ 5 (at) 67 " * 60]
    texts += [pii.planted("one word and more " * 40, seed, 14)[0] for seed in range(12)]
    spans = 0
    for text, found in zip(texts, tagger.decode(texts)):
        tags = np.zeros(len(text), dtype=int)
        for x, k, y in found:
            tags[x:y] = k + 1
        assert tags.tolist() == (best_path(tagger, text) if text else [])
        spans += len(found)
    assert spans > 60


def test_added_spans_on_held_out_texts(tagger):
    """Precision and recall of what is added to the rules' spans, on texts with forms and numbers that training hasn't seen."""
    right = wrong = all_ = 0
    for seed in range(1000, 1200):
        text, spans = pii.planted("some words of a text that has none of it " * 12, seed, 4)
        base = pii.base_spans(text)
        want = {s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in base)}
        got = set(pii.all_spans(text, tagger.decode([text])[0])) - set(base)
        right, wrong, all_ = right + len(want & got), wrong + len(got - want), all_ + len(want)
    print(f"precision {right / (right + wrong):.3f}, recall {right / all_:.3f} of {all_}")
    assert right >= 0.98 * (right + wrong) and right >= 0.8 * all_


def test_only_what_passes_its_check_is_added():
    card = "4111.1111.1111.1111"
    assert pii.all_spans(f"x {card} y", [(2, 2, 21)]) == [(2, 2, 21)]
    assert pii.all_spans("x 4111.1111.1111.1112 y", [(2, 2, 21)]) == []  # Luhn
    assert pii.all_spans(f"x 9.{card} y", [(4, 2, 23)]) == [] and pii.all_spans(f"x {card}7 y", [(2, 2, 21)]) == []  # a part of more
    assert pii.all_spans("ip 10[.]0[.]0[.]256 x", [(3, 1, 19)]) == [] and pii.all_spans("ip 10[.]0[.]0[.]25 x", [(3, 1, 18)]) == [(3, 1, 18)]
    assert pii.all_spans("ann (at) x (dot) org", [(1, 0, 18)]) == [(0, 0, 20)] and pii.all_spans("meet at home", [(0, 0, 12)]) == []


@pytest.mark.parametrize("module", [secrets, pii])
def test_odd_rows(spark, module, tagger):
    long = "word " * 60_000 + "password=abcdefgh ann@example.com"
    rows = [(1, None), (2, ""), (None, "token: abcdef123 1.2.3.4"), (4, long), (4, long), (5, "1 2 3 4 5.6@ " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n_hex")
    scan = (lambda d: module.scan(d)) if module is secrets else (lambda d: module.scan(d, tagger))
    name = "secrets" if module is secrets else "pii"
    got = scan(df).selectExpr("doc_id", f"{name}.*").collect()
    assert len(got) == 6
    by = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in by)
    assert len({r.spans for r in got if r.doc_id == 4}) == 1 and all(r.spans for r in got if r.doc_id == 4)
    assert scan(df.where("doc_id = 99")).count() == 0
