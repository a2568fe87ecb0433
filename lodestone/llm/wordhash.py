"""Vectorised hashing of words, shingles and windows. A word is a run of bytes other than space and \\t\\n\\v\\f\\r."""

from __future__ import annotations

import numpy as np

U = np.uint64
P, Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
P_INV, Q_INV = U(pow(int(P), -1, 1 << 64)), U(pow(int(Q), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """1, base, base^2, ... modulo 2^64."""
    kept = _kept.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 4096), base, dtype=U)
        kept[0] = U(1)
        kept = _kept[int(base)] = np.multiply.accumulate(kept)
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~BLANK[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for every word, piece by piece so that a very long text needs little memory."""
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        piece = data[at:end]
        start, stop = spans(piece)
        if len(start):
            total = np.zeros(len(piece) + 1, dtype=U)
            np.cumsum((np.frombuffer(piece, dtype=np.uint8).astype(U) + U(1)) * powers(P, len(piece)), out=total[1:])
            out.append(mix((total[stop] - total[start]) * powers(P_INV, len(piece))[start] + (stop - start).astype(U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive words."""
    if len(words) < n:
        return np.zeros(0, dtype=U)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * powers(Q, len(words)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(Q_INV, len(words) + 1)[: len(words) - n + 1])


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of n-word shingle hashes; a text under n words is one shingle of all it has, an empty one has none."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    return np.unique(grams(words, min(n, len(words)))) if len(words) else words


def sliding(values: np.ndarray, width: int, how) -> np.ndarray:
    """how (np.minimum or np.maximum) over every `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = how(out[:-have], out[have:])
        have *= 2
    return how(out[: len(out) - (width - have)], out[width - have :]) if width > have else out
