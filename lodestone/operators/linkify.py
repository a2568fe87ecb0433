"""Plain text as safe HTML: comments with links for URLs and known names, short messages with links for URLs, handles and tags."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a URL, a handle and a tag are; signs that aren't a URL's end; where handles and tags lead.
URL, HANDLE, TAG = r"https?://\S+", r"@[A-Za-z0-9_]+", r"#[A-Za-z0-9_Ѐ-ӿ]+"
NOT_AT_END = ".,;:!?)'\">"
PROFILE, SEARCH = "https://x.com/", "https://x.com/search?q="
#: A URL that was broken by line ends.
BROKEN = re.compile(r"(https?://\S*)\n+")
MESSAGE = re.compile(f"(?P<url>{URL})|(?P<handle>{HANDLE})|(?P<tag>{TAG})")


def anchor(href: str, shown: str) -> str:
    return f'<a href="{escape(href)}" target="_blank" rel="noopener noreferrer">{escape(shown)}</a>'


def replaced(text: str, found: re.Pattern, link: Callable[[str, str], str]) -> str:
    """The text escaped, with link(kind, match) for each match."""
    out, at = [], 0
    for m in found.finditer(text):
        out += [escape(text[at : m.start()]), link(m.lastgroup, m.group())]
        at = m.end()
    return "".join([*out, escape(text[at:])])


def of_url(url: str) -> str:
    """A URL's link; signs at its end that are hardly its own are left out."""
    url = url.rstrip(NOT_AT_END)
    return anchor(url, url)


def pattern(names: dict[str, str]) -> re.Pattern:
    """URLs first, then names, the longest first."""
    known = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return re.compile(f"(?P<url>{URL})" + (f"|(?P<name>{known})" if known else ""))


def linked(text: str | None, names: dict[str, str], found: re.Pattern) -> str:
    """A comment's text; a name without a URL stays as it is."""

    def link(kind: str, shown: str) -> str:
        if kind == "url":
            return of_url(shown)
        return anchor(names[shown], shown) if names[shown] else escape(shown)

    return replaced(text or "", found, link)


def linked_message(text: str | None) -> str:
    """A short message's text; URLs that line ends broke are joined first."""

    def link(kind: str, shown: str) -> str:
        if kind == "url":
            return of_url(shown)
        return anchor(PROFILE + shown[1:] if kind == "handle" else SEARCH + quote(shown), shown)

    return replaced(BROKEN.sub(r"\1", text or ""), MESSAGE, link)


def linkify(text: Column, names: dict[str, str] | None = None) -> Column:
    """Comments. `names` is a vocabulary of profile names to URLs that goes with the task; join large ones instead."""
    names = names or {}
    found = pattern(names)
    return F.pandas_udf(lambda s: pd.Series([linked(x, names, found) for x in s]), "string")(text)


def linkify_message(text: Column) -> Column:
    """Short messages."""
    return F.pandas_udf(lambda s: pd.Series([linked_message(x) for x in s]), "string")(text)
