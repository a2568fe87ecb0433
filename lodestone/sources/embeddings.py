"""Vectors from a provider, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Texts of one call.
BATCH = 128


def ordered(response: dict, wanted: int) -> list[list[float]]:
    """The vectors of a response in the order of its index; a response of another size is an error."""
    rows = sorted(response["data"], key=lambda r: r["index"])
    if len(rows) != wanted:
        raise ValueError(f"{len(rows)} vectors for {wanted} texts")
    return [r["embedding"] for r in rows]


def embed(texts: DataFrame, call: Callable[[list[str]], dict], batch: int = BATCH) -> DataFrame:
    """(id, embedding) of (id, text); `call` gives the provider's response for a list of texts, and runs on executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": ordered(call(part["text"].tolist()), len(part))})

    return texts.where("text <> ''").select("id", "text").mapInPandas(run, "id bigint, embedding array<float>")
