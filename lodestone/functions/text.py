"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the activity log's row texts.
ACTION_PREFIX = r"(?iU)^(?:shared|added|updated|commented|wrote|checked in|was (?:with|at)|tagged|posted|replied)[^.]*\."
RESHARE_PREFIX = r"(?iU)^shared\s+a(?!\s+link)\b[^.]*\."
VISIBILITY_TIME = r"(?iU)\s*(?:Public|Friends|Custom|Only me|Close Friends)\s*\d{1,2}:\d{2}[ \s]*(?:AM|PM)?\s*(?:View)?\s*$"
TRAILING_VIEW = r"(?iU)\s*View\s*$"
TRAILING_AGE = r"(?iU)\s*\d+[smhd]\s*(?:Mark\s+as\s+read)?\s*$"
LEADING_UNREAD = r"(?iU)^Unread\s*"

# English function words by which an ASCII question counts as English.
ENGLISH_WORDS = (
    "the is and what do you to a an of in i me my your are was were be been this that it for on at with as by or but not no yes have has had will would can "
    "could should about from if how when why where who which any all some more most"
).split()

URL = r"(?i)https?://\S+|www\.\S+"
WORD = "[а-яёa-z]{3,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fix_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1; anything else stays as it is."""
    raw = F.encode(c, "ISO-8859-1")
    return F.when(c.rlike(r"^[\x00-\xff]*$") & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(c)


def plain_mentions(c: Column) -> Column:
    """@[id:offset:Name] becomes @Name."""
    return F.regexp_replace(c, r"@\[\d+:\d+:([^\]]+)\]", "@$1")


def archive_text(c: Column) -> Column:
    return plain_mentions(fix_encoding(F.coalesce(c, F.lit(""))))


def clean_activity(c: Column) -> Column:
    """A row's own words: without the unread mark, the action, visibility and time, and the age of a notice."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), LEADING_UNREAD, "")
    c = F.regexp_replace(F.regexp_replace(c, ACTION_PREFIX, ""), r"(?U)^\s+", "")
    for pattern in (VISIBILITY_TIME, TRAILING_VIEW, TRAILING_AGE):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def clean_commentary(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), VISIBILITY_TIME, "")
    return strip(F.regexp_replace(c, TRAILING_VIEW, ""))


def is_reshare(c: Column) -> Column:
    return c.rlike(RESHARE_PREFIX)


def hashtags(c: Column) -> Column:
    """Every tag without #, in order, any script."""
    return F.regexp_extract_all(c, F.lit(r"(?U)#(\w+)"), 1)


def short_hashtags(c: Column) -> Column:
    """Lower-case Latin and Cyrillic tags, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"#([A-Za-z0-9_Ѐ-ӿ]+)"), 1), F.lower)


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"@([A-Za-z0-9_]+)"), 1)


def words(c: Column) -> Column:
    """Lower-case words of three letters or more, URLs left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, URL, " ")), F.lit(WORD), 0)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, for search."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_tokens(text: str, least: int) -> list[str]:
    return [t for t in text.split() if len(t) >= least]


def holds(c: Column, part: str) -> Column:
    """Contains without regard to case; % and _ are ordinary characters."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def holds_any(c: Column, parts: list[str]) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(low, F.lit(part.lower()))
    return found


def language(c: Column) -> Column:
    """ru, en or other, by script and by English function words."""
    c = F.coalesce(c, F.lit(""))
    # what is left when runs of all else go: one match for each run, not for each letter
    left = lambda pattern: F.length(F.regexp_replace(c, pattern, ""))
    cyrillic, ascii_, other = left("[^Ѐ-ӿ]+"), left("[^A-Za-z]+"), left(r"[\P{L}A-Za-zЀ-ӿ]+")
    total = cyrillic + ascii_ + other
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), 0)
    english = (F.size(found) < 3) | (F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in ENGLISH_WORDS]))) >= 2)
    return (
        F.when(total < 1, "other")
        .when((total >= 3) & (cyrillic / total > 0.30), "ru")
        .when(other >= 1, "other")
        .when((cyrillic / total < 0.05) & english, "en")
        .otherwise("other")
    )


def question_key(c: Column) -> Column:
    """A digest that is the same for questions that differ in case and spacing only."""
    return F.sha2(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "), 256)


def address_digest(address: Column, salt: str) -> Column:
    """What stands for a caller's address, which is itself never kept; callers without one are one caller."""
    return F.when(F.coalesce(address, F.lit("")) == "", "").otherwise(F.sha2(F.concat(F.lit(f"{salt}|"), address), 256))


def caller_address(real: Column, forwarded: Column, remote: Column) -> Column:
    """The address that a proxy names, else the first of those it was forwarded for, else that of the connection."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.coalesce(strip(some(real)), strip(F.split(some(forwarded), ",")[0]), remote)


def embed_input(title: Column, body: Column, most: int = 32_000) -> Column:
    parts = F.array(strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit(""))))
    return F.substring(collapse(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")), 1, most)


def slug(c: Column) -> Column:
    """ASCII slug of text that is ASCII once its accents are split off; other letters are dropped."""
    c = F.lower(F.regexp_replace(F.translate(c, "àáâäãåçèéêëìíîïñòóôöõùúûüýÿÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"), r"[^\x00-\x7f]", ""))
    c = F.trim(F.regexp_replace(c, r"[^\w\s-]", ""))
    return F.regexp_replace(F.regexp_replace(c, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def titled(c: Column) -> Column:
    """Each run of letters with a capital at its start."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def humanise(c: Column) -> Column:
    """A profile's slug as a name: parts between dots are words, and those of digits at the end go; without a dot CamelCase is split."""
    dotted = F.regexp_replace(c, r"^\d+(?:\.\d+)*$|(?:\.\d+)+$", "")
    words = F.when(~c.contains("."), F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")).when(dotted == "", c).otherwise(F.replace(dotted, F.lit("."), F.lit(" ")))
    return titled(words)


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    return holds_any(F.coalesce(c, F.lit("")), list(parts))


# What titles of an archive's posts say of them.
MEMORY, MARKET, FUNDRAISER = ("shared a memory",), ("shared a product",), ("shared a fundraiser",)
COMMENT = ("commented on", "replied to")
SELF_DIRECT = ("his own post", "her own post", "his own photo", "her own photo", "his own reel", "her own reel")
SELF_REPLY = ("replied to his own comment", "replied to her own comment")


def title_kind(title: Column) -> Column:
    """memory, market, fundraiser, self_direct, self_reply, external or post."""
    return (
        F.when(any_of(title, MEMORY), "memory").when(any_of(title, MARKET), "market").when(any_of(title, FUNDRAISER), "fundraiser")
        .when(any_of(title, SELF_REPLY), "self_reply").when(any_of(title, SELF_DIRECT), "self_direct").when(any_of(title, COMMENT), "external").otherwise("post")
    )


# Fixed value: marks that models leave at the end of an answer.
ANSWER_TAIL = r"[\s\.]*\b(?:MODE\s*END|END\s*OF\s*RESPONSE|END_OF_TURN|<\|end\|>|<\|im_end\|>|<\|endoftext\|>)\b[\s\.]*$"


def answer(c: Column) -> Column:
    """An answer without a model's end mark; dots that it leaves become one."""
    kept = F.regexp_replace(F.regexp_replace(c, f"(?iU){ANSWER_TAIL}", ""), r"(?U)\s+$", "")
    return F.when(kept.endswith(".."), F.regexp_replace(kept, r"\.+$", ".")).otherwise(kept)
