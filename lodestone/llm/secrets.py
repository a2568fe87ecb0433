"""Secret scan by one deterministic automaton for all rules.

Each rule is a regular expression over bytes with a least length. All rules are compiled together, from their first byte to their last:
parsed to a nondeterministic automaton, made deterministic by subset construction over byte classes, minimised by
partition refinement and laid out as transition arrays whose accepting states come last. One pass over a text's UTF-8 bytes
runs all rules at once and tells where a match of a rule ends. Two more automata of that rule alone, compiled in the same way,
then read the match again: the one of its reverse, backwards, gives the leftmost start, the other gives the longest end.

Cases: a null text counts as empty and has no spans; very long texts, and texts that are one match or full of matches, are read in
time in proportion to their length, and beside the text only its spans are kept; rows that repeat a doc_id are scanned each; an
empty table gives no rows; other columns stay as they are, but for a column `secrets`, whose place the result takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

# The contract's rules, then those of well-known token formats, as (kind, regular expression, least length).
# Of assign the length of the value counts. A run of 24 or more is what is left of all runs once shorter ones are dropped.
RULES = (
    ("assign", rb"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", 6),
    ("access", rb"AKIA[A-Z0-9]+", 20),
    ("hex", rb"[0-9a-f]" * 24 + rb"[0-9a-f]*", 24),
    ("pem", rb"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0),
    ("github", rb"gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = 3


def atoms(pattern: bytes):
    """Parse a pattern of literals, [classes], (groups|of|them) and ? * + to a tree."""

    def members(i: int) -> tuple[frozenset, int]:
        end, out = pattern.index(b"]", i), set()
        while i < end:
            if i + 2 < end and pattern[i + 1 : i + 2] == b"-":
                out.update(range(pattern[i], pattern[i + 2] + 1))
                i += 3
            else:
                i += pattern[i : i + 1] == b"\\"
                out.add(pattern[i])
                i += 1
        return frozenset(out), end + 1

    def parse(i: int):
        options, row = [], []
        while i < len(pattern) and pattern[i : i + 1] != b")":
            c = pattern[i : i + 1]
            if c == b"|":
                options.append(("all", row))
                row, i = [], i + 1
            elif c in b"?*+":
                row[-1] = (c.decode(), row[-1])
                i += 1
            elif c == b"(":
                node, i = parse(i + 1)
                row.append(node)
                i += 1
            elif c == b"[":
                node, i = members(i + 1)
                row.append(("set", node))
            else:
                i += c == b"\\"
                row.append(("set", frozenset([pattern[i]])))
                i += 1
        return ("any", [*options, ("all", row)]), i

    return parse(0)[0]


def reverse(node):
    """The tree of the pattern read backwards."""
    kind, value = node
    if kind == "set":
        return node
    if kind in ("all", "any"):
        turned = [reverse(x) for x in value]
        return kind, turned[::-1] if kind == "all" else turned
    return kind, reverse(value)


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.steps) - 1

    def add(self, node, at: int) -> int:
        """Grow the automaton by the node from state `at`; its end."""
        kind, value = node
        if kind == "set":
            end = self.state()
            self.steps[at] = (value, end)
            return self._open(end)
        if kind == "all":
            for x in value:
                at = self.add(x, at)
            return at
        if kind == "any":
            end = self.state()
            for x in value:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(end)
            return self._open(end)
        start, end = self.state(), self.state()
        self.empty[at].append(start)
        last = self.add(value, start)
        self.empty[last].append(end)
        if kind in "?*":
            self.empty[at].append(end)
        if kind in "*+":
            self.empty[last].append(start)
        return self._open(end)

    def _open(self, end: int) -> int:
        out = self.state()  # a state without a step of its own, so that the next node can start here
        self.empty[end].append(out)
        return out

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    arrays: list[list[int]]  # for each state, the next one for each byte
    start: int
    accepting: int  # states from here on accept
    rules: list[tuple[int, ...]]  # for each accepting state, the rules that hold
    dead: int  # the state that nothing leads out of, if there is one


@cache
def compiled(patterns: tuple[bytes, ...], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """The minimal automaton that, after each byte, tells which patterns end there; `anywhere`: if they start at any byte, not at the first alone."""
    nfa, ends = Nfa(), {}
    root = nfa.state()
    for k, p in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        ends[nfa.add(reverse(atoms(p)) if backwards else atoms(p), start)] = k
    # bytes that no step tells apart share a column
    sets = sorted({s[0] for s in nfa.steps if s}, key=sorted)
    column_of, columns = [], {}
    for b in range(256):
        column_of.append(columns.setdefault(tuple(b in s for s in sets), len(columns)))
    sample = {c: column_of.index(c) for c in columns.values()}
    # subset construction on bit sets; where a match may start anywhere the root stays in every subset
    reach = [sum(1 << x for x in nfa.closed([s[1]])) if s else 0 for s in nfa.steps]
    leads = [[c for c in range(len(columns)) if s and sample[c] in s[0]] for s in nfa.steps]
    first = sum(1 << x for x in nfa.closed([root]))
    always = first if anywhere else 0
    ids, todo, table_ = {first: 0}, [first], []
    for now in todo:
        got = [always] * len(columns)
        rest = now
        while rest:
            x = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            for c in leads[x]:
                got[c] |= reach[x]
        for x in got:
            if x not in ids:
                ids[x] = len(ids)
                todo.append(x)
        table_.append([ids[x] for x in got])
    says = [tuple(sorted(k for x, k in ends.items() if s >> x & 1)) for s in ids]
    # partition refinement until no block's states differ in the blocks they lead to
    block, leading = {s: k for k, s in enumerate(sorted(set(says)))}, np.array(table_)
    part = np.array([block[s] for s in says])
    while True:
        new = np.unique(np.column_stack([part, part[leading]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    part = part.tolist()
    kept = {p: i for i, p in reversed(list(enumerate(part)))}
    order = sorted(kept, key=lambda p: (bool(says[kept[p]]), p))
    place = {p: k for k, p in enumerate(order)}
    arrays = [[place[part[table_[kept[p]][c]]] for c in column_of] for p in order]
    plain = sum(not says[kept[p]] for p in order)
    dead = next((place[part[i]] for x, i in ids.items() if not x), -1)
    return Automaton(arrays, place[part[0]], plain, [says[kept[p]] for p in order[plain:]], dead)


def ends(data: bytes, automaton: Automaton) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(byte, rules) wherever matches end, longer ones too: the one pass."""
    arrays, accepting, rules = automaton.arrays, automaton.accepting, automaton.rules
    state = automaton.start
    for at, byte in enumerate(data):
        state = arrays[state][byte]
        if state >= accepting:
            yield at, rules[state - accepting]


def last_accept(data: bytes, automaton: Automaton, at: int, stop: int, step: int) -> tuple[int, int]:
    """From `at` on, in steps of 1 or -1 and before `stop`: the first and the last byte after which the automaton accepts, -1 if none."""
    state, first, last = automaton.start, -1, -1
    while at != stop:
        state = automaton.arrays[state][data[at]]
        if state == automaton.dead:
            break
        if state >= automaton.accepting:
            first, last = at if first < 0 else first, at
        at += step
    return first, last


class Rule:
    """One rule's matches in one text: leftmost and without overlap."""

    def __init__(self, k: int):
        self.kind, self.pattern, self.least = RULES[k]
        self.after = 0  # where its last match ends
        self.state, self.at = -1, 0  # of a scan of its own, needed only while a match that starts in the last one would go on

    def meet(self, data: bytes, end: int) -> tuple[int, int] | None:
        """The match that ends first at byte `end`, at its full length, if it starts behind the last one and is long enough."""
        if end < self.after:
            return None
        if self.state >= 0 and not self._own(data, end):
            return None
        _, start = last_accept(data, compiled((self.pattern,), False, True), end, self.after - 1, -1)
        if start < 0:
            self.state, self.at = compiled((self.pattern,)).start, self.after
            self._own(data, end)
            return None
        first, last = last_accept(data, compiled((self.pattern,), False), start, len(data), 1)
        self.after, self.state = last + 1, -1
        return (start, last + 1) if last + 1 - (first if self.kind == "assign" else start) >= self.least else None

    def _own(self, data: bytes, end: int) -> bool:
        alone = compiled((self.pattern,))
        while self.at <= end:
            self.state = alone.arrays[self.state][data[self.at]]
            self.at += 1
        return self.state >= alone.accepting


def in_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, in one pass over the text."""
    point, before, points = 0, 0, {}
    for at in sorted({x for a, _, b in found for x in (a, b)}):
        point += len(data[before:at].decode("utf-8"))
        before, points[at] = at, point
    return [(points[a], k, points[b]) for a, k, b in found]


def all_rules() -> Automaton:
    return compiled(tuple(r[1] for r in RULES))


def spans(text: str | None, automaton: Automaton | None = None) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points of every secret, sorted; leftmost and without overlap for each rule."""
    data = (text or "").encode("utf-8", "replace")
    rules, found = [Rule(k) for k in range(len(RULES))], []
    for at, ended in ends(data, automaton or all_rules()):
        for k in ended:
            if span := rules[k].meet(data, at):
                found.append((span[0], k, span[1]))
    if found and len(data) != len(text):
        found = in_points(data, found)
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in found)


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """`docs` and a struct `secrets`: counts of the base rules, the digest of their spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(all_rules())  # compiled once; its size follows from the rules

    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            all_ = spans(text, shared.value)
            base = [s for s in all_ if s[1] < BASE]
            rows.append((*(sum(s[1] == k for s in base) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.withColumn("secrets", F.pandas_udf(found, FOUND)("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


def _matches(k: int) -> str:
    """SQL for one rule: the lengths of its matches and of what is between them give the places."""
    kind, pattern, least = RULES[k]
    pattern = pattern.decode() if kind != "hex" else "[0-9a-f]+"
    pattern = ("(?:" + pattern.replace("(", "(?:") + ")").replace("'", "''")
    length = f"length(regexp_replace(m, '^[A-Za-z_]+[\"'']? *[:=] *[\"'']?', ''))" if kind == "assign" else "length(m)"
    return f"""select doc_id, {k} as k, start, start + length(m) as stop from (
        select doc_id, m, sum(length(gap)) over (partition by doc_id order by i) + sum(length(m)) over (partition by doc_id order by i) - length(m) as start from (
            select doc_id, unnest(ms) as m, unnest(gaps[:len(ms)]) as gap, generate_subscripts(ms, 1) as i from (
                select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gaps from d)))
        where {length} >= {least}"""


_KIND = "case k " + " ".join(f"when {k} then '{r[0]}'" for k, r in enumerate(RULES)) + " end"
_JOINED = f"string_agg({_KIND} || ':' || start || ':' || stop, ',' order by start, k)"
SECRETS_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(_matches(k) for k in range(len(RULES)))}),
g as (select doc_id, {", ".join(f"count(*) filter (k = {k}) as n_{RULES[k][0]}" for k in range(BASE))}, {_JOINED} filter (k < {BASE}) as base, {_JOINED} as spans from s group by 1)
select doc_id, {", ".join(f"coalesce(n_{RULES[k][0]}, 0) as n_{RULES[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)
"""
