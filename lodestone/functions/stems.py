"""Stems of English and Russian words by the published Snowball rules, as Column functions.

A step looks for the longest of its endings and acts if it lies in the step's region. Endings are one pattern anchored at the end of the word: as
a search takes the leftmost match, it is the longest ending. Regions are counted from the start of the word and stay while endings go.
Each step's result is bound to a name (by a lambda over an array of one), so an expression grows with the steps, not with their product.

Stem distinct words and join or sum again; a text's words are far more than the words of a language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

Step = Callable[[Column], Column]


def chained(word: Column, steps: list[Step]) -> Column:
    return let(word, lambda w: chained(steps[0](w), steps[1:])) if steps else word


def ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has, else an empty text."""
    return F.regexp_extract(word, f"(?:{'|'.join(endings)})$", 0)


def cut_by(word: Column, n: int | Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def after(word: Column, pattern: str) -> Column:
    """How many letters the pattern takes at the start, all of the word if it isn't there."""
    return F.when(word.rlike(f"^{pattern}"), F.length(F.regexp_extract(word, f"^{pattern}", 0))).otherwise(F.length(word))


# ---------------------------------------------------------------- Russian
# Vowels and endings of the published rules.
RU_VOWELS = "аеиоуыэюя"
PERFECTIVE_1, PERFECTIVE_2 = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_1, PARTICIPLE_2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _either(first: list[str], second: list[str]) -> str:
    """Endings of a first group, which stand behind а or я, and of a second one."""
    return f"(?:(?<=[ая])(?:{'|'.join(first)})|{'|'.join(second)})"


_GERUND, _VERB = _either(PERFECTIVE_1, PERFECTIVE_2), _either(VERB_1, VERB_2)
_ADJECTIVAL = f"{_either(PARTICIPLE_1, PARTICIPLE_2)}?(?:{'|'.join(ADJECTIVE)})"


def _without(word: Column, pattern: str) -> Column:
    return F.regexp_replace(word, f"{pattern}$", "")


def _inflection(rv: Column) -> Column:
    """Step 1: a perfective gerund, else a reflexive and then an adjectival, a verbal or a nominal ending."""

    def rest(x: Column) -> Column:
        first = [F.when(x.rlike(f"{p}$"), _without(x, p)) for p in (_ADJECTIVAL, _VERB, f"(?:{'|'.join(NOUN)})")]
        return F.coalesce(*first, x)

    return F.when(rv.rlike(f"{_GERUND}$"), _without(rv, _GERUND)).otherwise(let(_without(rv, "(?:ся|сь)"), rest))


def russian(word: Column) -> Column:
    """The stem of a word in lower case; ё is е. A word without a vowel stays."""
    v, c = f"[{RU_VOWELS}]", f"[^{RU_VOWELS}]"

    def stem(w: Column) -> Column:
        head = after(w, f"{c}*{v}")
        second = after(w, f"{c}*{v}+{c}+{v}+{c}")  # where R2 starts

        def derived(rv: Column) -> Column:
            """Step 3: its ending has to lie behind both the first vowel and the start of R2."""
            low = F.greatest(second - head, F.lit(0))
            return F.concat(F.substring(rv, F.lit(1), low), _without(F.substring(rv, low + 1, F.length(rv)), "(?:ость|ост)"))

        def tidy(rv: Column) -> Column:
            superlative = _without(rv, "(?:ейше|ейш)")
            return F.when(rv.rlike("нн$"), cut_by(rv, 1)).when(rv.rlike("(?:ейше|ейш)$"), let(superlative, lambda x: F.when(x.rlike("нн$"), cut_by(x, 1)).otherwise(x))).otherwise(_without(rv, "ь"))

        steps = [_inflection, lambda rv: _without(rv, "и"), derived, tidy]
        return F.concat(F.substring(w, F.lit(1), head), chained(F.substring(w, head + 1, F.length(w)), steps))

    return let(F.translate(word, "ё", "е"), stem)


# ---------------------------------------------------------------- English
# Vowels, double letters, letters before li, endings and exceptions of the published rules.
EN_VOWELS, DOUBLE, BEFORE_LI = "aeiouy", "bb|dd|ff|gg|mm|nn|pp|rr|tt", "[cdeghkmnrt]"
PREFIXES = "gener commun arsen".split()
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME, SAME_NOW = "sky news howe atlas cosmos bias andes".split(), "inning outing canning herring earring proceed exceed succeed".split()
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_V, _C = f"[{EN_VOWELS}]", f"[^{EN_VOWELS}]"
#: A short syllable at the end: vowel and consonant at the start, or consonant, vowel and a consonant other than w, x and Y.
_SHORT = f"(?:^{_V}{_C}|{_C}{_V}[^{EN_VOWELS}wxY])$"


def _mapped(word: Column, table: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Column:
    """The word with its longest ending of the table replaced, where that is allowed (ending, letters before it)."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def change(found: Column) -> Column:
        before = cut_by(word, F.length(found))
        return F.when((found != "") & allowed(found, before), F.concat(before, F.try_element_at(names, found))).otherwise(word)

    return let(ending(word, table), change)


def _plural(w: Column) -> Column:
    """Step 1a."""
    return (
        F.when(w.rlike("sses$"), cut_by(w, 2))
        .when(w.rlike("(?:ied|ies)$"), F.when(F.length(w) > 4, cut_by(w, 2)).otherwise(cut_by(w, 1)))
        .when(w.rlike("(?:us|ss)$"), w)
        .when(w.rlike(f"{_V}.+s$"), cut_by(w, 1))
        .otherwise(w)
    )


def _past(w: Column, r1: Column) -> Column:
    """Step 1b, with e put back or a double letter made single."""

    def bare(x: Column) -> Column:
        short = x.rlike(_SHORT) & (F.length(x) <= r1)
        return F.when(x.rlike("(?:at|bl|iz)$") | (short & ~x.rlike(f"(?:{DOUBLE})$")), F.concat(x, F.lit("e"))).when(x.rlike(f"(?:{DOUBLE})$"), cut_by(x, 1)).otherwise(x)

    def change(found: Column) -> Column:
        before = cut_by(w, F.length(found))
        return (
            F.when(found.isin("eed", "eedly"), F.when(F.length(before) >= r1, F.concat(before, F.lit("ee"))).otherwise(w))
            .when((found != "") & before.rlike(_V), let(before, bare))
            .otherwise(w)
        )

    return let(ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")), change)


def english(word: Column) -> Column:
    """The stem of a word in lower case. Words of two letters or fewer stay."""

    def regions(w: Column) -> Column:
        first = F.when(w.rlike(f"^(?:{'|'.join(PREFIXES)})"), F.length(F.regexp_extract(w, f"^(?:{'|'.join(PREFIXES)})", 0))).otherwise(after(w, f"{_C}*{_V}+{_C}"))
        return let(first, lambda r1: let(r1 + after(F.substring(w, r1 + 1, F.length(w)), f"{_C}*{_V}+{_C}"), lambda r2: steps(w, r1, r2)))

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        inside = lambda before, r: F.length(before) >= r
        two = lambda found, before: inside(before, r1) & F.when(found == "ogi", before.endswith("l")).when(found == "li", before.rlike(f"{BEFORE_LI}$")).otherwise(True)
        three = lambda found, before: inside(before, r1) & ((found != "ative") | inside(before, r2))
        four = lambda found, before: inside(before, r2) & ((found != "ion") | before.rlike("[st]$"))

        def last(x: Column) -> Column:
            before = cut_by(x, 1)
            e = x.endswith("e") & (inside(before, r2) | (inside(before, r1) & ~before.rlike(_SHORT)))
            return F.when(e | (x.endswith("ll") & inside(before, r2)), before).otherwise(x)

        rest = [
            lambda x: _past(x, r1),
            lambda x: F.when(x.rlike(f"^.+{_C}[yY]$"), F.concat(cut_by(x, 1), F.lit("i"))).otherwise(x),
            lambda x: _mapped(x, STEP_2, two),
            lambda x: _mapped(x, STEP_3, three),
            lambda x: _mapped(x, dict.fromkeys(STEP_4, ""), four),
            last,
        ]
        known = lambda x: F.when(x.isin(*SAME_NOW), x).otherwise(chained(x, rest))
        return F.lower(chained(w, [lambda x: F.regexp_replace(x, "(?:'s'|'s|')$", ""), _plural, known]))

    special = F.create_map(*[F.lit(x) for kv in (SPECIAL | dict(zip(SAME, SAME))).items() for x in kv])

    def stem(w: Column) -> Column:
        # y that is a consonant: at the start and behind a vowel; of a run of vowels and y every other y
        marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^'", ""), "^y", "Y"), f"({_V})y", "$1Y")
        return F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.try_element_at(special, w), let(marked, regions)))

    return let(word, stem)


def stem(word: Column) -> Column:
    """Russian rules for a word with a Cyrillic letter, English ones for a word of ASCII letters and marks; others stay."""
    return F.when(word.rlike("[а-яё]"), russian(word)).when(word.rlike("^[a-z']+$"), english(word)).otherwise(word)
