"""Quality rules on the level of hosts, in DataFrame functions only.

Each document is measured once (words, symbols, repeated lines, words in repeated windows) and fails rules of its own. Failures are summed
by host and rule. A host's rate is shrunk to what hosts have in common: the beta prior of the rule is fitted to all hosts by moments
(the variance between hosts beyond that of the binomial), so that a host with three documents tells little and one with a million speaks for
itself. Verdicts are joined back to the documents: a host that fails a rule too often is watched, and the rule's strict limit
holds there instead of the lenient one; a host almost all of whose documents fail something is rejected with all of them.

At scale: texts are read once and leave the scan as a few numbers, which are kept in the shared folder. Sums by host are
combined before the shuffle. Only hosts that aren't trusted are joined to the documents: broadcast if they are few and their names short,
else joined by a key that is computed anew, so that the join can split a host with most of the documents. Windows are found by
sorting them within the text: n log n in its words, whatever it repeats.

Cases: a null or empty text has no words and fails the base rule; documents without a host share one; equal rows are judged each; rates of
a single host or of equal hosts aren't shrunk apart; an empty table gives no rows; columns beside doc_id, text and the host aren't
read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

BLANK = r"[\x20\x09-\x0D]+"
WORDLESS, SYMBOL = r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Words of a window that counts as repeated; least words of a document; most words of repeated windows, in percent.
WINDOW, LEAST_WORDS, REPEATED = 3, 50, 50


@dataclass(frozen=True)
class Rule:
    """A condition that fails a document of a trusted host, and the one that fails a document of a host that is watched for it."""

    name: str
    lenient: str
    strict: str


BASE = Rule("base", f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words", f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words")
RULES = (
    BASE,
    Rule("symbols", "10 * n_symbols > word_chars", "50 * n_symbols > word_chars"),
    Rule("lines", "2 * n_dup_lines > n_lines", "5 * n_dup_lines > 2 * n_lines"),
    Rule("length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
)
#: Shrunk rates above which a host is watched for a rule, and above which of any failure it is rejected.
WATCH, REJECT = 0.25, 0.9
#: The prior counts for at least and at most so many documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1_000_000.0
#: Hosts and bytes of their names that are broadcast.
HOSTS, NAMES = 50_000, 4 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """(doc_id, host, the COUNTS) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host.cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORDLESS))
    rows = rows.select("doc_id", "host", F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"), lines.alias("lines"), F.array_remove(F.split("text", BLANK), "").alias("words"))
    n = F.size("words")
    rows = rows.select("doc_id", "host", "n_symbols", F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("distinct"), n.alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), sorted_windows(n).alias("windows"))
    rows = rows.select("doc_id", "host", "n_symbols", "n_lines", "n_words", "word_chars", (F.col("n_lines") - F.col("distinct")).alias("n_dup_lines"), repeated_words().alias("n_repeat_words"))
    return rows.select("doc_id", "host", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def sorted_windows(n: Column) -> Column:
    """The windows of WINDOW words with their places, sorted by their words."""
    shifted = [F.slice("words", k + 1, F.greatest(n, F.lit(1))) for k in range(1, WINDOW)]
    zipped = F.arrays_zip("words", *shifted, F.sequence(F.lit(0), n - 1))
    return F.when(n >= WINDOW, F.sort_array(F.slice(zipped, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))))


#: The fields of a window as arrays_zip() names them: its words and its place.
FIELDS, PLACE = ("words", *map(str, range(1, WINDOW))), str(WINDOW)


def repeated_words() -> Column:
    """The words in windows that stand beside an equal one when sorted."""
    pairs = F.arrays_zip("windows", F.slice("windows", 2, F.greatest(F.size("windows"), F.lit(1))))
    equal = F.filter(pairs, lambda pair: reduce(Column.__and__, [pair["windows"][f] == pair["1"][f] for f in FIELDS]))
    places = F.transform(equal, lambda pair: F.array(*[pair[x][PLACE] + k for x in ("windows", "1") for k in range(WINDOW)]))
    return F.coalesce(F.array_size(F.array_distinct(F.flatten(places))), F.lit(0))


def by_host(rows: DataFrame) -> DataFrame:
    """(host, n, a sum for each rule, failing): documents and failures of each host."""
    fails = [F.coalesce(F.expr(r.lenient), F.lit(False)) for r in RULES]
    sums = [F.sum(f.cast("long")).alias(r.name) for r, f in zip(RULES, fails, strict=True)]
    return rows.groupBy("host").agg(F.count("*").alias("n"), *sums, F.sum(reduce(Column.__or__, fails).cast("long")).alias("failing"))


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """rule -> (mean, documents that the prior counts for), by moments over the hosts. One row comes to the driver."""
    names = [*[r.name for r in RULES], "failing"]
    square = lambda f: F.sum(F.round(f * f / F.col("n"), 6).cast("decimal(38,6)"))
    row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("nn"), *[F.sum(c).alias(c) for c in names], *[square(F.col(c)).alias(f"{c}_2") for c in names]).first()
    return {c: prior(row["k"], row["n"] or 0, float(row["nn"] or 0), row[c] or 0, float(row[f"{c}_2"] or 0)) for c in names}


def prior(k: int, n: int, nn: float, fails: int, squares: float) -> tuple[float, float]:
    """Mean and strength of the beta prior for k hosts of n documents, nn their squares' sum, `squares` the sum of fails * fails / n by host."""
    mean = fails / n if n else 0.0
    within = mean * (1 - mean)
    spread = squares - 2 * mean * fails + mean * mean * n
    room = within * (n - (nn / n if n else 0.0) - (k - 1))
    between = (spread - within * (k - 1)) / room if room > 0 else 0.0
    return mean, min(MOST_PRIOR, max(LEAST_PRIOR, (1 - between) / between if between > 0 else MOST_PRIOR))


def verdicts(hosts: DataFrame) -> DataFrame:
    """(host, rejected, a column watched_<rule> for each rule but the base, rate_<rule> and rate_failing): what the shrunk rates say."""
    fitted = priors(hosts)
    rate = {c: ((F.col(c) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))) for c, (mean, strength) in fitted.items()}
    watched = [(rate[r.name] > WATCH).alias(f"watched_{r.name}") for r in RULES if r is not BASE]
    return hosts.select("host", (rate["failing"] > REJECT).alias("rejected"), *watched, *[rate[c].alias(f"rate_{c}") for c in rate])


def judged(docs: DataFrame, host: Column) -> DataFrame:
    """The COUNTS of each document, base_failed, kept, and of its host host_rejected and host_watched."""
    rows = cut(measured(docs, host))
    named = [f"watched_{r.name}" for r in RULES if r is not BASE]
    marked = cut(verdicts(by_host(rows)).where(" or ".join(["rejected", *named])).select("host", "rejected", *named))
    count, size = marked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    marked = marked.select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("key"), "rejected", *named)
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))
    rows = rows.join(F.broadcast(marked) if count <= HOSTS and size <= NAMES else marked, "key", "left")
    base, failed = F.expr(BASE.lenient), F.coalesce("rejected", F.lit(False))
    for r in RULES:
        watched = F.lit(False) if r is BASE else F.coalesce(f"watched_{r.name}", F.lit(False))
        failed = failed | F.expr(r.lenient) | (watched & F.expr(r.strict))
    any_watched = F.exists(F.array(*named), lambda x: F.coalesce(x, F.lit(False)))
    return rows.select("doc_id", *COUNTS, base.alias("base_failed"), (~failed).alias("kept"), F.coalesce("rejected", F.lit(False)).alias("host_rejected"), any_watched.alias("host_watched"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, docs["source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected", "host_watched")


_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
_NAMES = [*[r.name for r in RULES], "failing"]
_FAILS = {r.name: r.lenient for r in RULES} | {"failing": " or ".join(f"({r.lenient})" for r in RULES)}


def _rate(c: str) -> str:
    """SQL for a host's shrunk rate: the prior's strength is (1 - b) / b for b, the share of the variance that lies between hosts."""
    mean = f"(s.{c} / s.n)"
    within = f"({mean} * (1 - {mean}))"
    room = f"({within} * (s.n - s.nn / s.n - (s.k - 1)))"
    between = f"((s.{c}_2 - 2 * {mean} * s.{c} + {mean} * {mean} * s.n - {within} * (s.k - 1)) / {room})"
    strength = f"(case when {room} > 0 then case when {between} > 0 then least({MOST_PRIOR}, greatest({LEAST_PRIOR}, (1 - {between}) / {between})) else {MOST_PRIOR} end else {MOST_PRIOR} end)"
    return f"((h.{c} + {mean} * {strength}) / (h.n + {strength}))"


HOST_SQL = f"""
with d as (select row_number() over () as id, doc_id, source as host, coalesce(text, '') as t from documents),
w as (select id, doc_id, host, {_WORDS} as ws, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDLESS}')) as ls from d),
g as (select id, i, count(*) over (partition by id, a, b, c) as times
      from (select id, unnest(range(1, len(ws) - 1)) as i, unnest(ws[1:len(ws) - 2]) as a, unnest(ws[2:len(ws) - 1]) as b, unnest(ws[3:]) as c from w where len(ws) > 2)),
r as (select id, count(distinct p) as n_repeat_words from (select id, unnest([i, i + 1, i + 2]) as p from g where times > 1) group by 1),
m as (select id, doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '{SYMBOL}'))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join r using (id)),
h as (select host, count(*)::double as n, {", ".join(f"(count(*) filter ({_FAILS[c]}))::double as {c}" for c in _NAMES)} from m group by 1),
s as (select count(*)::double as k, sum(n) as n, sum(n * n) as nn, {", ".join(f"sum({c}) as {c}, sum(round({c} * {c} / n, 6)) as {c}_2" for c in _NAMES)} from h),
v as (select host, {_rate("failing")} > {REJECT} as rejected, {", ".join(f"{_rate(r.name)} > {WATCH} as watched_{r.name}" for r in RULES if r is not BASE)} from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE.lenient}) as base_failed,
       not (rejected or {" or ".join(f"({r.lenient})" if r is BASE else f"({r.lenient}) or watched_{r.name} and ({r.strict})" for r in RULES)}) as kept,
       rejected as host_rejected, {" or ".join(f"watched_{r.name}" for r in RULES if r is not BASE)} as host_watched
from m join v on m.host is not distinct from v.host
"""
