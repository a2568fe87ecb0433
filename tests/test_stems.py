"""Stems against the published examples, and against the rules written once more in plain Python over many made and given words."""

import itertools
import random

from lodestone.functions import stems as S
from lodestone.operators import wordcloud

# Examples that are published with the rules.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist consolation consol console consol
 consolingly consol knack knack knackeries knackeri knaves knave knavish knavish kneaded knead knee knee kneeling kneel knightly knight knocker knocker knots knot skies sky dying die news news
 hopping hop hoping hope happy happi say say cry cri by by flies fli ties tie gas gas this this gaps gap kiwis kiwi luxuriated luxuri relational relat conditional condit inning inning succeeded succeed""".split()
RUSSIAN = """вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагонами вагон важная важн важнее важн важнейшие важн важничал важнича важности важност валентина валентин валерий валер валить вал
 падаль падал падающего пада пакет пакет""".split()


def longest(word, endings):
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def region(word, vowels, start=0):
    """Where what stands behind the first consonant after a vowel starts."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def english(word):
    vowels = S.EN_VOWELS
    if len(word) <= 2:
        return word
    if word in S.SPECIAL or word in S.SAME:
        return S.SPECIAL.get(word, word)
    w = list(word.removeprefix("'"))
    for k, c in enumerate(w):
        if c == "y" and (k == 0 or w[k - 1] in vowels):
            w[k] = "Y"
    w = "".join(w)
    prefix = next((p for p in S.PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else region(w, vowels)
    r2 = region(w, vowels, r1)
    has = lambda x: any(c in vowels for c in x)

    def short(x):
        if len(x) == 2:
            return x[0] in vowels and x[1] not in vowels
        return len(x) > 2 and x[-3] not in vowels and x[-2] in vowels and x[-1] not in vowels + "wxY"

    if e := longest(w, ["'", "'s", "'s'"]):
        w = w[: -len(e)]
    e = longest(w, ["sses", "ied", "ies", "us", "ss", "s"])
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and has(w[:-2]):
        w = w[:-1]
    if w not in S.SAME_NOW:
        e = longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
        if e in ("eed", "eedly"):
            w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
        elif e and has(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(tuple(S.DOUBLE.split("|"))):
                w = w[:-1]
            elif short(w) and len(w) <= r1:
                w += "e"
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
            w = w[:-1] + "i"
        e = longest(w, S.STEP_2)
        if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] in tuple(S.BEFORE_LI[1:-1])):
            w = w[: -len(e)] + S.STEP_2[e]
        e = longest(w, S.STEP_3)
        if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
            w = w[: -len(e)] + S.STEP_3[e]
        e = longest(w, S.STEP_4)
        if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
            w = w[: -len(e)]
        at = len(w) - 1
        if w.endswith("e") and (at >= r2 or at >= r1 and not short(w[:-1])) or w.endswith("ll") and at >= r2:
            w = w[:-1]
    return w.lower()


def russian(word):
    vowels = S.RU_VOWELS
    word = word.replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(word) if c in vowels), len(word))
    r2 = region(word, vowels, region(word, vowels))

    def off(w, first, second):
        """Without the longest ending of both groups, if one of the first has а or я before it."""
        e = longest(w[rv:], [*first, *second])
        if e and (e in second or w[rv : len(w) - len(e)].endswith(("а", "я"))):
            return w[: -len(e)]
        return None

    w = off(word, S.PERFECTIVE_1, S.PERFECTIVE_2)
    if w is None:
        w = off(word, [], ["ся", "сь"]) or word
        adjective = off(w, [], S.ADJECTIVE)
        if adjective is not None:
            w = off(adjective, S.PARTICIPLE_1, S.PARTICIPLE_2) or adjective
        else:
            w = off(w, S.VERB_1, S.VERB_2) or off(w, [], S.NOUN) or w
    w = off(w, [], ["и"]) or w
    e = longest(w[max(rv, r2) :], ["ост", "ость"])
    w = w[: -len(e)] if e else w
    if w[rv:].endswith("нн"):
        return w[:-1]
    if (s := off(w, [], ["ейш", "ейше"])) is not None:
        return s[:-1] if s[rv:].endswith("нн") else s
    return off(w, [], ["ь"]) or w


def stemmed(spark, words, stem):
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    return {r.w: r.s for r in frame.select("w", stem(S.F.col("w")).alias("s")).collect()}


def test_published_examples(spark):
    assert stemmed(spark, ENGLISH[::2], S.english) == dict(zip(ENGLISH[::2], ENGLISH[1::2]))
    assert stemmed(spark, RUSSIAN[::2], S.russian) == dict(zip(RUSSIAN[::2], RUSSIAN[1::2]))


def made(roots, endings, n, seed):
    r = random.Random(seed)
    every = ["".join(x) for x in itertools.chain(itertools.product(roots, endings), itertools.product(roots, endings, endings))]
    return sorted(set(r.sample(every, n)))


def test_many_english_words(spark, sf_dir):
    roots = "b be by say yy ayyy play boy youth hop rapp bid gener generat commun arsen univers st str est at bl iz trap try e o ow ax fl electr form hope' log theol sky ski rate ll install".split()
    endings = ["", "y", "s", "'s", "'", "es", "ies", "ied", "us", "ss", "eed", "eedly", "ed", "edly", "ing", "ingly", *S.STEP_2, *S.STEP_3, *S.STEP_4, "e", "l", "le"]
    words = [*made(roots, endings, 6000, 1), *S.SPECIAL, *S.SAME, *S.SAME_NOW, "", "a", "'", "''s", "y", "bcd"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(S.F.explode(S.F.split("text", "[^a-z]+")).alias("w")).distinct().limit(3000)
    words = sorted({*words, *[r.w for r in docs.collect()]})
    got = stemmed(spark, words, S.english)
    assert [(w, got[w], english(w)) for w in words if got[w] != english(w)] == []


def test_many_russian_words(spark):
    roots = "дел люб красив важн юн ёл стр а я е вст прочита написа книг длинн остр ость мощн рассказ".split()
    endings = ["", "ся", "сь", *S.PERFECTIVE_1, *S.PERFECTIVE_2, *S.ADJECTIVE, *S.PARTICIPLE_1, *S.PARTICIPLE_2, *S.VERB_1, *S.VERB_2, *S.NOUN, "ост", "ость", "ейш", "ейше", "нн", "и", "ь"]
    words = [*made(roots, endings, 8000, 2), "", "б", "бвг", "ь", "ся"]
    got = stemmed(spark, words, S.russian)
    assert [(w, got[w], russian(w)) for w in words if got[w] != russian(w)] == []


def test_script_decides(spark):
    assert stemmed(spark, ["running", "книги", "été", "x1", "日本", ""], S.stem) == {"running": "run", "книги": "книг", "été": "été", "x1": "x1", "日本": "日本", "": ""}
    assert spark.range(1).select(S.stem(S.F.lit(None).cast("string")).alias("s")).first().s is None


def test_cloud_of_stems(spark):
    texts = spark.createDataFrame([("cats running with cats",), ("cat runs, the cat and running cats",), (None,)], "content_text string")
    got = {r.term: r.n for r in wordcloud.cloud(texts, stem=S.stem).collect()}
    assert got == {"cat": 5, "run": 3}
    assert {r.term: r.n for r in wordcloud.stemmed(texts.selectExpr("'cats run' as term", "1L as n"), S.stem).collect()} == {"cat run": 3}


def test_each_word_of_many_pairs_is_stemmed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @S.F.udf("string")
    def stem(w):
        calls.add(1)
        return w.rstrip("s")

    names = [f"w{k}x" for k in range(30)]
    terms = [(x, 1) for x in names] + [(f"{x} {y}s", 2) for x in names for y in names] + [("thes w1x", 9), ("w1x thes", 9), ("thes", 9)]
    got = {r.term: r.n for r in wordcloud.stemmed(spark.createDataFrame(terms, "term string, n long"), stem).collect()}
    assert got == {x: 1 for x in names} | {f"{x} {y}": 2 for x in names for y in names}, "terms with a stem that is a stop word go"
    assert calls.value == 2 * len(names) + 1


def test_query(spark, sf_dir):
    from lodestone.plans.catalogue import QUERIES

    rows = QUERIES["word_stems"](spark, sf_dir).collect()
    assert rows and all(r.stem == (russian(r.word) if any("а" <= c <= "ё" for c in r.word) else english(r.word)) for r in rows)
    assert len({r.stem for r in rows}) < len(rows)
