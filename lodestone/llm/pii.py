"""Personal data by exact rules and by a character-level bidirectional LSTM with CRF transitions.

Rules give the base spans: mail addresses, IP addresses, card numbers and phone numbers. The model finds what is written in forms that the
rules don't know: bracketed or spaced mail and IP addresses, cards with other separators, phones without a prefix. It is trained in
numpy on windows of a bounded sample of documents, whose spans are those of the rules and of forms that are put in between words.

Every added span needs a digit, an @ or a bracketed `at`; so only the surroundings of these, REACH characters to both sides, go through
the network, and all else is outside. They are cut into overlapping windows; emissions of a character come from the window in which it
lies most centrally, so neighbouring windows are reconciled, and the CRF's best path is that of the text as a whole, framed by
outside: a character is settled beforehand only where no path can gain by leaving outside there. A decoded span is added if a text of its
kind's form overlaps most of it, passes the kind's check (digits, octets, Luhn), stands apart from other digits and letters,
and touches no base span; base spans always stay.

Cases: a null text counts as empty and has no spans; very long texts are worked off in slices of windows, and a span across
slices stays one; rows that repeat a doc_id are scanned each; an empty table trains nothing and adds nothing; other columns
stay as they are, but for a column `pii`, whose place the result of scan() takes.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

KINDS = ("email", "ip", "card", "phone")
# The rules of the contract.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a leftmost match starts where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Windows of training text at most, documents they come from at most, and the seed of the first weights.
TRAIN_WINDOWS, TRAIN_DOCS, STEPS, SEED = 3000, 800, 150, 11
WINDOW, STRIDE, HIDDEN = 128, 112, 8
#: Characters around a digit, an @ or a bracketed `at` that go through the network.
REACH = 96
TRIGGER = re.compile(r"[0-9@]+|[\[({] ?(?i:at) ?[\])}]")
# The forms a decoded span must have, by kind.
FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+(?: ?@ ?| ?[\[({] ?(?i:at) ?[\])}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?i:dot) ?[\])}] ?)[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:(?: ?\. ?| ?[\[(]\.[\])] ?)[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9]){11,18}"),
    re.compile(r"(?:\(0?[0-9]{2,5}\)|0[0-9]{1,6}|[0-9]{3}(?=[ .-][0-9]{3}[ .-][0-9]{4}))(?:[ ./-]{1,3}[0-9]{2,8}){1,5}"),
)
MARGIN = (WINDOW - STRIDE) // 2
#: Windows that are run through the network at once.
BATCH = 2048


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, sorted. Mail addresses are looked for at each @, which is exact and linear."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(n := part.lstrip("0")) < 4 and int(n or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def symbols(text: str) -> np.ndarray:
    """1-128: ASCII; 129: other letters and signs. 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return (np.minimum(points, 128) + 1).astype(np.uint8)


def starts_of(n: int) -> np.ndarray:
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows over one text, padded at its end."""
    starts = starts_of(len(ids))
    padded = np.zeros(starts[-1] + WINDOW, dtype=np.uint8)
    padded[: min(len(ids), len(padded))] = ids[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Tagger:
    """Two LSTMs with piecewise linear gates, a linear layer over both and CRF transitions; tag 0 is outside, then KINDS."""

    def __init__(self, seed: int = SEED):
        r, h, k = np.random.default_rng(seed), HIDDEN, len(KINDS) + 1
        self.p = {
            "x": r.normal(0, 0.5, (2, 130, 4 * h)).astype(np.float32), "u": r.normal(0, 0.3, (2, h, 4 * h)).astype(np.float32),
            "o": r.normal(0, 0.3, (2 * h, k)).astype(np.float32), "b": np.zeros(k, dtype=np.float32), "a": np.zeros((k, k), dtype=np.float32),
        }
        self.p["x"][:, :, :h] += 1  # forget little at first
        self.p["b"][0] = 2.0

    def states(self, ids: np.ndarray, keep: bool = False):
        """Hidden states (time, batch, 2h) of windows (batch, time); gate order f, i, o, g. keep: also what back() needs."""
        n, t, h = *ids.shape, HIDDEN
        seq = np.stack([ids.T, ids.T[::-1]], 1)  # time, direction, batch
        hs = np.zeros((2, n, h), dtype=np.float32)
        c = np.zeros_like(hs)
        out, kept = np.empty((t, 2, n, h), dtype=np.float32), []
        for k in range(t):
            z = np.matmul(hs, self.p["u"])
            z[0] += self.p["x"][0][seq[k, 0]]
            z[1] += self.p["x"][1][seq[k, 1]]
            gates = z[..., : 3 * h] * np.float32(0.2) + np.float32(0.5)
            np.clip(gates, 0, 1, out=gates)
            g = np.clip(z[..., 3 * h :], -1, 1)
            before = (c, hs)
            c = gates[..., :h] * c + gates[..., h : 2 * h] * g
            squashed = np.clip(c, -1, 1)
            hs = gates[..., 2 * h :] * squashed
            out[k] = hs
            if keep:
                kept.append((gates, g, c, squashed, *before))
        both = np.concatenate([out[:, 0], out[::-1, 1]], -1)
        return (both, seq, kept) if keep else both

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(batch, time, tags): states() without what only training needs, in buffers that are used again at every step."""
        (n, t), h = ids.shape, HIDDEN
        scale, shift = np.repeat(np.float32([0.2, 1]), (3 * h, h)), np.repeat(np.float32([0.5, 0]), (3 * h, h))
        low, high = np.repeat(np.float32([0, -1]), (3 * h, h)), np.ones(4 * h, dtype=np.float32)
        x, u = (self.p["x"] * scale + shift).reshape(-1, 4 * h), self.p["u"] * scale
        at = np.concatenate([ids.T, ids.T[::-1] + np.int64(130)], 1).astype(np.intp)  # time, both directions' batches
        z, gathered = np.empty((2, n, 4 * h), dtype=np.float32), np.empty((2 * n, 4 * h), dtype=np.float32)
        c, squashed, out = np.zeros((2, n, h), dtype=np.float32), np.empty((2, n, h), dtype=np.float32), np.zeros((t + 1, 2, n, h), dtype=np.float32)
        for k in range(t):
            np.matmul(out[k], u, out=z)
            np.take(x, at[k], axis=0, out=gathered, mode="clip")
            z += gathered.reshape(z.shape)
            np.maximum(z, low, out=z)
            np.minimum(z, high, out=z)
            c *= z[..., :h]
            np.multiply(z[..., h : 2 * h], z[..., 3 * h :], out=squashed)
            c += squashed
            np.clip(c, -1, 1, out=squashed)
            np.multiply(z[..., 2 * h : 3 * h], squashed, out=out[k + 1])
        o = self.p["o"]
        return (out[1:, 0] @ o[:h] + out[:0:-1, 1] @ o[h:] + self.p["b"]).transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tag paths."""
        n, t, h = *ids.shape, HIDDEN
        both, seq, kept = self.states(ids, keep=True)
        e, a = (both @ self.p["o"] + self.p["b"]).astype(np.float64), self.p["a"].astype(np.float64)
        up, down = np.empty_like(e), np.zeros_like(e)
        up[0] = e[0]
        for k in range(1, t):
            up[k] = logsum(up[k - 1][:, :, None] + a, 1) + e[k]
        for k in range(t - 2, -1, -1):
            down[k] = logsum(a + (e[k + 1] + down[k + 1])[:, None, :], 2)
        z = logsum(up[-1], 1)
        de = np.exp(up + down - z[None, :, None])
        da = np.exp(up[:-1, :, :, None] + a + (e[1:] + down[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        y = tags.T.astype(np.int64)
        de[np.arange(t)[:, None], np.arange(n), y] -= 1
        da -= np.bincount((y[:-1] * len(a) + y[1:]).ravel(), minlength=a.size).reshape(a.shape)
        de = (de / n).astype(np.float32)
        grad = {"a": (da / n).astype(np.float32), "b": de.sum((0, 1)), "o": np.tensordot(both, de, ((0, 1), (0, 1))), "x": np.zeros_like(self.p["x"]), "u": np.zeros_like(self.p["u"])}
        moved = np.empty((t, 2, n, 4 * h), dtype=np.float32)
        dboth = de @ self.p["o"].T
        dout = np.stack([dboth[..., :h], dboth[::-1, :, h:]], 1)
        dh, dc = np.zeros((2, n, h), dtype=np.float32), np.zeros((2, n, h), dtype=np.float32)
        for k in range(t - 1, -1, -1):
            gates, g, c, squashed, c0, h0 = kept[k]
            f, i, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            dh = dh + dout[k]
            dc = dc + dh * o * (np.abs(c) < 1)
            dz = np.concatenate([dc * c0, dc * g, dh * squashed], -1) * ((gates > 0) & (gates < 1)) * np.float32(0.2)
            dz = np.concatenate([dz, dc * i * (np.abs(g) < 1)], -1)
            grad["u"] += np.matmul(h0.transpose(0, 2, 1), dz)
            moved[k] = dz
            dh, dc = np.matmul(dz, self.p["u"].transpose(0, 2, 1)), dc * f
        for d in range(2):
            marks = np.zeros((t * n, len(grad["x"][d])), dtype=np.float32)
            marks[np.arange(t * n), seq[:, d].ravel()] = 1
            grad["x"][d] = marks.T @ moved[:, d].reshape(t * n, -1)
        return grad

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 0.03) -> Tagger:
        r, m, v = np.random.default_rng(SEED), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(ids), min(batch, len(ids)))
            for k, g in self.gradients(ids[pick], tags[pick]).items():
                g = np.clip(g, -5, 5)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def tags(self, emission: np.ndarray) -> np.ndarray:
        """The best path for one stretch (time, tags)."""
        a, best, back = self.p["a"], emission[0], []
        for e in emission[1:]:
            all_ = best[:, None] + a
            back.append(all_.argmax(0))
            best = all_.max(0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of each text's decoded spans."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        waiting: list[Slice] = []
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a text, the stretch that a later slice may go on with
        have = 0
        for k, text in enumerate(texts):
            for low, high in surroundings(text):
                cut = windows(symbols(text[low:high]))
                for at in range(0, len(cut), BATCH):
                    waiting.append(Slice(k, low, high, at, cut[at : at + BATCH], at + BATCH >= len(cut)))
                    have += len(waiting[-1].windows)
                    if have >= BATCH:
                        self._flush(waiting, found)
                        waiting, have = [], 0
        if waiting:
            self._flush(waiting, found)
        return found

    def gain(self) -> float:
        """What a path's transitions can gain at most by another tag in the place of outside at one character, whatever its neighbours' tags are."""
        a = self.p["a"].astype(np.float64)
        into, out = (a - a[:, :1])[:, None, :], (a - a[:1])[None].transpose(0, 2, 1)  # before, after, tag
        return max(0.0, float((into + out).max()))

    def _flush(self, waiting: list[Slice], found: list) -> None:
        e = self.emissions(np.concatenate([s.windows for s in waiting]))
        # where outside is ahead by more than transitions can gain, every best path is outside
        doubtful = e[..., 0] - e[..., 1:].max(-1) < self.gain() + 1e-3
        row = 0
        for s in waiting:
            n = len(s.windows)
            at, inner = np.nonzero(doubtful[row : row + n])
            value = e[row : row + n][at, inner]
            row += n
            # central emissions: the outer half of each overlap belongs to the neighbour
            window = s.first + at
            own = ((inner >= MARGIN) | (window == 0)) & ((inner < WINDOW - MARGIN) | (s.last & (at == n - 1)))
            place = s.low + window * STRIDE + inner
            own &= place < s.high
            decided = s.high if s.last else s.low + (s.first + n) * STRIDE + MARGIN
            self._follow(s, place[own], value[own], decided, found[s.text])

    def _follow(self, s: Slice, place: np.ndarray, value: np.ndarray, decided: int, spans: list) -> None:
        """The best path through the doubtful characters of a slice, with what earlier slices left open."""
        if s.text in self.open:
            before = self.open.pop(s.text)
            place, value = np.r_[before[0], place], np.vstack([before[1], value])
        stretches = np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) > 1) + 1) if len(place) else []
        if len(place) and not s.last and place[-1] + 1 >= decided:
            rest = stretches.pop()
            self.open[s.text] = place[rest], value[rest]
        for x in stretches:
            # before and behind a stretch the path is known to be outside
            tags = self.tags(np.vstack([OUTSIDE, value[x], OUTSIDE]))[1:-1]
            edge = np.flatnonzero(np.diff(np.r_[0, tags, 0]))
            spans += [(int(place[x[0]] + i), int(tags[i]) - 1, int(place[x[0]] + j)) for i, j in zip(edge, edge[1:]) if tags[i]]


@dataclass
class Slice:
    """Some windows of a part of a text: its number, the part's bounds, the first window's number, and whether the part ends with them."""

    text: int
    low: int
    high: int
    first: int
    windows: np.ndarray
    last: bool


def surroundings(text: str) -> list[list[int]]:
    """The parts of a text that can hold an added span, in order and apart from each other."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return out


OUTSIDE = np.array([[0.0] + [-1e4] * len(KINDS)])


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def snapped(kind: int, a: int, b: int, text: str) -> tuple[int, int, int] | None:
    """The text of the kind's form that overlaps most of a decoded span, if it passes the check."""
    overlaps = ((min(b, m.end()) - max(a, m.start()), m.start(), m.end()) for m in FORMS[kind].finditer(text, max(0, a - 24), b + 24))
    common, start, end = max(overlaps, default=(0, 0, 0))
    if common < 0.6 * max(b - a, end - start):
        return None
    piece, digits = text[start:end], digits_of(text[start:end])
    fine = (kind != 1 or all(int(x) <= 255 for x in re.findall("[0-9]+", piece))) and (kind != 2 or luhn(digits)) and (kind != 3 or 9 <= len(digits) <= 15)
    around = text[max(0, start - 2) : start], text[end : end + 2]
    apart = not (around[0][-1:].isalnum() or around[1][:1].isalnum())
    if kind:  # a part of a longer number is none
        apart = apart and not re.search(r"[0-9+][ ./_-]?\Z", around[0]) and not re.match(r"[ ./_-]?[0-9]", around[1])
    return (start, kind, end) if fine and apart else None


def all_spans(text: str, decoded: list[tuple[int, int, int]], base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """The rules' spans and those of the decoded ones that are added; of two added ones that overlap the first stays."""
    out = base_spans(text) if base is None else list(base)
    taken = sorted((a, b) for a, _, b in out)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    end = 0
    for s in sorted(x for x in (snapped(k, a, b, text) for a, k, b in decoded) if x):
        k = bisect_left(starts, s[2])  # the base spans that start before its end
        if s[0] >= end and (not k or reach[k - 1] <= s[0]):
            out.append(s)
            end = s[2]
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Writer:
    """Personal data in forms that the rules don't know, and numbers that are none."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self, low: int, high: int) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(low, high)))

    def card(self) -> str:
        d = self.r.choice("3456") + self.digits(self.r.choice((14, 14, 14, 13, 12)))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def form(self) -> tuple[int, str]:
        r, kind = self.r, self.r.randrange(4)
        if kind == 0:
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", "."), (" {at} ", " {dot} "), (" (AT) ", " (DOT) ")))
            user = r.choice((self.name(3, 9), f"{self.name(2, 6)}.{self.name(3, 8)}", self.name(2, 6) + self.digits(2)))
            return kind, user + at + self.name(3, 9) + dot + r.choice(("com", "org", "net", "de", "io", "fr"))
        if kind == 1:
            return kind, r.choice((" . ", "[.]", "(.)", " .", ". ", " [.] ")).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            card = self.card()
            return kind, r.choice((".", "/", " - ", "_", "  ", " / ")).join(card[i : i + 4] for i in range(0, len(card), 4))
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return kind, r.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{r.randint(1, 9)}{a}/{b}{c}", f"00{r.randint(1, 9)}{r.randint(0, 9)} {a} {b} {c}", f"0{a} {b} {c}", f"(0{a}) {b}{c}"))

    def other(self) -> str:
        r = self.r
        return r.choice((self.digits(r.randint(1, 25)), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"{self.digits(2)}.{self.digits(2)}", f"No. {self.digits(6)}", f"${self.digits(3)},{self.digits(3)}.00", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{self.digits(4)} {self.digits(4)}", f"@{self.name(3, 9)}", f"see @ {self.name(2, 5)} at {self.name(3, 6)}", f"({self.digits(4)})"))


def planted(text: str, seed: int, n: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with n pieces of Writer put in behind its words, and the spans of those that are personal data."""
    writer, spans, out, at, length = Writer(seed), [], [], 0, 0
    gaps = [m.end() for m in re.finditer(r"\s", text)] or [len(text)]
    for gap in sorted(writer.r.choice(gaps) for _ in range(n)):
        kind, piece = writer.form() if writer.r.random() < 0.7 else (-1, writer.other())
        out += [text[at:gap], piece, " "]
        length += gap - at
        if kind >= 0:
            spans.append((length, kind, length + len(piece)))
        length, at = length + len(piece) + 1, gap
    return "".join(out) + text[at:], spans


def training_windows(text: str) -> list[tuple[bytes, bytes]]:
    """A document's windows with a span, once pieces are planted in it, and as many others, as symbols and tags."""
    text, spans = planted(text, zlib.crc32(text.encode("utf-8", "replace")), 6)
    ids, tags = symbols(text), np.zeros(len(text), dtype=np.uint8)
    for a, k, b in [*reversed(base_spans(text)), *spans]:
        tags[a:b] = k + 1
    x, y = windows(ids), windows(tags)
    marked = np.flatnonzero(y.any(1))
    other = np.flatnonzero(~y.any(1))[: max(1, len(marked) // 2)]
    return [(x[i].tobytes(), y[i].tobytes()) for i in (*marked, *other)]


def fit(docs: DataFrame, most: int = TRAIN_WINDOWS, docs_most: int = TRAIN_DOCS) -> Tagger | None:
    """A tagger trained on at most `most` windows from at most `docs_most` documents, those with a digit or an @ first."""
    def cut(batches):
        for batch in batches:
            rows = [w for t in batch.text for w in training_windows(t or "")]
            yield pd.DataFrame(rows, columns=["x", "y"])

    ids = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").rlike("[0-9@]").alias("hit")).orderBy(F.desc("hit"), F.xxhash64("doc_id", F.lit("pii")), "doc_id").limit(docs_most)
    # at most docs_most ids are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("text").mapInPandas(cut, "x binary, y binary")
    rows = sorted((bytes(r.x), bytes(r.y)) for r in sample.orderBy(F.xxhash64("x"), "x").limit(most).collect())
    if not rows:
        return None
    x, y = (np.frombuffer(b"".join(r[k] for r in rows), dtype=np.uint8).reshape(-1, WINDOW) for k in (0, 1))
    return Tagger().train(x, y)


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, model: Tagger | None, redact: bool = False, into: str = "pii") -> DataFrame:
    """`docs` and a struct `into`: rule counts per kind, the digest of the rules' spans, all spans, and the text with <KIND> for each span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        decoded = shared.value.decode(texts) if shared.value else [[] for _ in texts]
        rows = []
        for text, extra in zip(texts, decoded):
            base = base_spans(text)
            spans = all_spans(text, extra, base)
            rows.append((*(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), masked(text, spans) if redact and spans else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.withColumn(into, F.pandas_udf(found, FOUND)("text"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if b > at:  # spans of two kinds may overlap: what is left of the second goes too
            if a >= at:
                out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = b
    return "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pii = scan(docs, fit(docs)).select("doc_id", "pii.*")
    return pii.drop("redacted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked; n_chars follows the text."""
    found = scan(docs, fit(docs), redact=True, into="__pii")
    masked_ = F.col("__pii.redacted")
    n_chars = F.when(masked_.isNull(), F.col("n_chars")).otherwise(F.length(masked_)).cast("long")
    return found.withColumn("n_chars", n_chars).withColumn("text", F.coalesce(masked_, "text")).drop("__pii")
