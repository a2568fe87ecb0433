"""Working through rows that are sorted by a key, and joining the members of one set in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The batches of a partition sorted by key, cut anew so that no key is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        at = int(np.searchsorted(values != values[-1], False)) if values[0] == values[-1] else int(np.flatnonzero(values != values[-1])[-1]) + 1
        if at:
            yield pd.concat([*held, batch.iloc[:at]], ignore_index=True)
            held = []
        elif held and held[-1][key].iat[-1] != values[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(batch.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def edges_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, dtype=int)


class Sets:
    """Disjoint sets of 0..n-1, named by their smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def names(self) -> np.ndarray:
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up
        return self.parent


def linked(adjacent: np.ndarray) -> np.ndarray:
    """For each member of a boolean matrix of links, the smallest member it reaches."""
    names = np.arange(len(adjacent))
    while True:
        new = np.minimum(names, np.where(adjacent, names[None, :], len(names)).min(1, initial=len(names)))
        new = new[new]
        if (new == names).all():
            return names
        names = new


def in_cells(chunk: Column, chunks: Column) -> Column:
    """The pairs (i, j), i <= j, of chunks in which a row of `chunk` meets rows of all chunks."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(x, chunk).alias("i"), F.greatest(x, chunk).alias("j")))
