"""Dates as exports and readers write them, as UTC; inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, English by their first three letters, Russian by prefix in this order.
ENGLISH_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
FULL_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
RUSSIAN_MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}
# Events that readers name instead of a date.
NAMED_DATES = {r"(?iU)(начал[оауы]\s+войн|war\s+start|invasion\s+of\s+ukraine|вторжен.{0,4}\s+в\s+украин)": "2022-02-24"}
# Seconds of a unit in "3 hours ago".
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def english_month(word: Column) -> Column:
    known = F.lower(word).rlike(rf"(?i)^({FULL_MONTHS})$")
    return F.when(known, F.try_element_at(F.create_map(*[x for m, n in ENGLISH_MONTHS.items() for x in (F.lit(m), F.lit(n))]), F.substring(F.lower(word), 1, 3)))


def russian_month(word: Column) -> Column:
    out = None
    for prefix, n in RUSSIAN_MONTHS.items():
        out = (F if out is None else out).when(F.lower(word).startswith(prefix), n)
    return out


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none of that name."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def mentioned(question: Column, most: int = 3) -> Column:
    """The dates that a question names: ISO, d.m.y, Russian, English, then named events; each once, `most` at most."""
    found = lambda pattern: F.regexp_extract_all(question, F.lit(pattern), 0)
    part = lambda c, pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))
    iso, dot = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
    ru, en = r"(?iU)\b(\d{1,2})\s+([а-яё]+)\s+(\d{4})\b", r"(?U)\b([A-Z][a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})\b"
    lists = [
        F.transform(found(iso), lambda x: ymd(part(x, iso, 1), part(x, iso, 2), part(x, iso, 3))),
        F.transform(found(dot), lambda x: ymd(part(x, dot, 3), part(x, dot, 2), part(x, dot, 1))),
        F.transform(found(ru), lambda x: ymd(part(x, ru, 3), russian_month(part(x, ru, 2)), part(x, ru, 1))),
        F.transform(found(en), lambda x: ymd(part(x, en, 3), english_month(part(x, en, 1)), part(x, en, 2))),
        *[F.array(F.when(question.rlike(pattern), F.lit(day).cast("date"))) for pattern, day in NAMED_DATES.items()],
    ]
    return F.slice(F.array_distinct(F.filter(F.concat(*lists), lambda x: x.isNotNull())), 1, most)


def epoch_seconds(c: Column) -> Column:
    """Seconds of an epoch that may be in milliseconds."""
    return F.when(c > 10**12, F.floor(c / 1000)).otherwise(c).cast("long")


def parsed(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def iso(c: Column) -> Column:
    """ISO text with Z, an offset or none; UTC if none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def archive_stamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))


def takeout(c: Column) -> Column:
    """A takeout's stamp; the formats that it uses have an offset or none."""
    return iso(F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(.*)$", "$1T$2$3"))


def resolve(utime: Column, iso_text: Column, raw: Column, collected: Column) -> Column:
    """The time of an activity log's row, in seconds.

    An epoch decides unless the raw text names a month; then ISO text; then, relative to when it was collected, now, today (at
    noon), yesterday, so many units ago, a full date, and a date without a year, which is last year's if it lay over a day ahead.
    """
    raw = F.coalesce(raw, F.lit(""))
    now = iso(collected)
    seconds = F.unix_seconds
    noon = lambda day: seconds(day.cast("timestamp")) + 43200
    ago = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    units = F.create_map(*[x for u, n in UNITS.items() for x in (F.lit(u), F.lit(n))])
    count = F.regexp_extract(raw, ago, 1).try_cast("long")
    past = count * F.try_element_at(units, F.lower(F.regexp_extract(raw, ago, 2)))
    clock = r"(?:\s+at\s+(\d{1,2}):(\d{2})[\s ]*(AM|PM))"
    full = rf"(?i)\b({FULL_MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}}){clock}?"
    turned = rf"(?i)\b(\d{{1,2}})\s+({FULL_MONTHS})\s+(\d{{4}}){clock}?"
    short = rf"(?i)\b({FULL_MONTHS})\s+(\d{{1,2}}){clock}?"

    def at(pattern: str, first: int) -> Column:
        hour, minute = F.regexp_extract(raw, pattern, first).try_cast("int"), F.regexp_extract(raw, pattern, first + 1).try_cast("int")
        evening = F.upper(F.regexp_extract(raw, pattern, first + 2)) == "PM"
        hour = F.when(evening & (hour != 12), hour + 12).when(~evening & (hour == 12), 0).otherwise(hour)
        return F.when((hour < 24) & (minute < 60), hour * 3600 + minute * 60).when(hour.isNull(), 43200)

    def group(pattern: str, g: int) -> Column:
        return F.nullif(F.regexp_extract(raw, pattern, g), F.lit(""))

    day = lambda y, m, d: seconds(ymd(y, m, d).cast("timestamp"))
    dated = F.coalesce(
        day(group(full, 3), english_month(group(full, 1)), group(full, 2)) + at(full, 4),
        day(group(turned, 3), english_month(group(turned, 2)), group(turned, 1)) + at(turned, 4),
    )
    yearless = lambda y: day(y, english_month(group(short, 1)), group(short, 2)) + at(short, 3)
    this = yearless(F.year(now))
    recent = F.when(this > seconds(now) + 86400, yearless(F.year(now) - 1)).otherwise(this)
    relative = (
        F.when(raw.rlike(r"(?i)\bjust\s+now\b"), seconds(now)).when(raw.rlike(r"(?i)\btoday\b"), noon(F.to_date(now)))
        .when(raw.rlike(r"(?i)\byesterday\b"), seconds(now) - 86400).when(past > 0, seconds(now) - past).otherwise(F.coalesce(dated, recent))
    )
    named = raw.rlike(rf"(?i)\b({FULL_MONTHS})\b")
    return F.coalesce(F.when((utime > 0) & ~named, epoch_seconds(utime)), seconds(iso(iso_text)), F.when(raw != "", relative))


def months_back(first: Column, last: Column) -> Column:
    """The first days of all months between two dates, newest first; empty if they are in the wrong order."""
    return F.when(first <= last, F.reverse(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))).otherwise(F.array().cast("array<date>"))


# A time of day, and names of months, which mark a full date.
CLOCK = r"(?i)\b(\d{1,2}):(\d{2})\s*(AM|PM)\b"
MONTH_NAME = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"


def from_clock(raw: Column, collected: Column) -> Column:
    """Seconds of a bare time of day: its latest occurrence at or before the collection, in UTC; null if there is a month's name or no time."""
    now = iso(collected)
    part = lambda g: F.regexp_extract(raw, CLOCK, g)
    hour = part(1).try_cast("int")
    hour = F.when((F.upper(part(3)) == "PM") & (hour != 12), hour + 12).when((F.upper(part(3)) == "AM") & (hour == 12), 0).otherwise(hour)
    at = F.unix_seconds(F.date_trunc("day", now)) + hour * 3600 + part(2).try_cast("int") * 60
    return F.when(~raw.rlike(MONTH_NAME), F.when(at > F.unix_seconds(now), at - 86400).otherwise(at))
