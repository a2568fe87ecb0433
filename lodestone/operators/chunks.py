"""Texts in overlapping chunks, and the list of those to embed again."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 800, 100
PARAGRAPH, SENTENCE = re.compile(r"\n(?=\n)"), re.compile(r"[.!?](?= )|\.(?=\n)")


def bounds(text: str, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Where each chunk of a text starts and ends: all places where a chunk may end are found once, and each end is looked up among them.

    Allowed are ends in the later half of a chunk: before the last empty line there, else behind the last sentence, else at full length.
    """
    empty_lines = [m.start() for m in PARAGRAPH.finditer(text)]
    sentences = [m.end() for m in SENTENCE.finditer(text)]

    def latest(places: list[int], low: int, high: int) -> int:
        k = bisect_right(places, high)
        return places[k - 1] if k and places[k - 1] >= low else 0

    at = 0
    while len(text) - at > target:
        middle, full = at + target // 2, at + target
        end = latest(empty_lines, middle, full - 2) or latest(sentences, middle + 1, full - 1) or full
        yield at, end
        at = max(at + 1, end - overlap)
    yield at, len(text)


def chunks_of(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text without white space at their ends; those of white space alone are left out."""
    text = (text or "").strip()
    return [c for a, b in bounds(text, target, overlap) if (c := text[a:b].strip())]


def chunk_array(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    return F.pandas_udf(lambda s: pd.Series([chunks_of(t, target, overlap) for t in s]), "array<string>")(text)


def embed_inputs(posts: DataFrame, title: str, body: str, reshared: str) -> DataFrame:
    """(id, chunk_index, text, content_hash). The title goes before the first chunk only; a post with a title alone is one chunk."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    text = F.array_join(F.filter(F.array(clean(body), clean(reshared)), lambda x: x != ""), "\n\n")
    found = chunk_array(text)
    found = posts.select("id", clean(title).alias("title"), found.alias("c"))
    found = found.withColumn("c", F.when((F.size("c") == 0) & (F.col("title") != ""), F.array("title")).when((F.size("c") > 0) & (F.col("title") != ""), F.transform("c", lambda x, i: F.when(i == 0, F.concat(F.col("title"), F.lit("\n\n"), x)).otherwise(x))).otherwise(F.col("c")))
    out = found.select("id", F.posexplode("c").alias("chunk_index", "text"))
    return out.withColumn("content_hash", F.sha2("text", 256))


def to_embed(current: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Rows of `current` (id, content_hash) that `stored` (id, content_hash, model, has_vector) doesn't hold as they are."""
    fresh = stored.where((F.col("model") == model) & F.col("has_vector")).select("id", "content_hash")
    return current.where(F.col("content_hash").isNotNull()).join(fresh, ["id", "content_hash"], "left_anti")
