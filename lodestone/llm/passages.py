"""Substring dedup with repeated-phrase automata.

A passage recurs if `window` consecutive words of a document also start in another one. Winnowed fingerprints of every document
are grouped first: two equal windows share the fingerprint that is least in them, so a window can only recur around a
fingerprint that recurs. Windows around those are grouped by hash, which confirms the recurring ones and names the first
document of each. Their words, taken from that document, are compiled into Aho-Corasick automata over word ids, in shards by the first
document. All documents are then streamed through the automata to locate every occurrence, word by word and exactly: in blocks of
words that overlap by a window less a word, and through the shards that hold a phrase with the hash of one of the block's windows,
as no other shard can have an occurrence there. A word is removed if an occurrence covers it whose phrase starts in a document with a smaller id.

Documents whose words are all those of a smaller document are settled at the start and leave the search.

Cases: null and empty texts have no words, keep nothing and are unharmed; texts under `window` words lose nothing; repeats within
one document count for nothing; rows that repeat a doc_id get a row each and take nothing from each other, whatever their texts;
rows without a doc_id lose nothing and take nothing from others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cells import edges_of, whole_keys
from lodestone.llm.common import apart, cut, dealt, maybe_in, table
from lodestone.llm.wordhash import P, grams, mix, powers, sliding, word_hashes

WINDOW, GRAM = 50, 10
#: Phrases of a shard, and blocks of documents that are streamed through one copy of a shard.
SHARD, STREAM = 10_000, 1000
#: Shards whose numbers of copies, 12 bytes each, are broadcast; beyond them they are joined.
SHARDS = 100_000
#: Places of a document after which its phrases may go to another shard, and words of a block but for what it shares with the next.
STRETCH, BLOCK = 2048, 4096


def fingerprints(words: np.ndarray) -> np.ndarray:
    """For every window, the least hash of GRAM words in it."""
    return sliding(grams(words, GRAM), WINDOW - GRAM + 1, np.minimum)


def whole_hash(words: np.ndarray) -> np.int64:
    """A hash of a whole sequence of words."""
    total = (words * powers(P, len(words) + 1)[1:]).sum(dtype=np.uint64, keepdims=True)
    return mix(total ^ np.uint64(len(words)))[0].astype(np.int64)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, version, n_words, text_hash, kept_sha256, prints): what is known before any comparison."""
    for batch in batches:
        rows = []
        for doc_id, version, text in zip(batch.doc_id, batch.version, batch.text):
            data = (text or "").encode("utf-8", "replace")
            words = word_hashes(data)
            prints = np.unique(fingerprints(words)) if len(words) >= WINDOW else words[:0]
            rows.append((doc_id, version, len(words), whole_hash(words) if len(words) else 0, sha(split(data)), prints.astype(np.int64)))
        yield pd.DataFrame(rows, columns=["doc_id", "version", "n_words", "text_hash", "kept_sha256", "prints"]).astype({"doc_id": "Int64"})


def split(data: bytes) -> list[bytes]:
    # bytes.split() knows the same six blanks
    return data.split()


def window_hashes(size: int):
    """(value, doc_id, place) of windows around recurring fingerprints, each once per block of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, prints in zip(batch.doc_id, batch.text, batch.prints):
                words = word_hashes(text.encode("utf-8", "replace"))
                at = np.flatnonzero(np.isin(fingerprints(words).astype(np.int64), prints))
                value = grams(words, WINDOW)[at].astype(np.int64)
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // size)) + 1):
                    each, first = np.unique(value[part], return_index=True)
                    yield pd.DataFrame({"value": each, "doc_id": doc_id, "place": at[part][first]})

    return run


def phrases(doc_id: int, words: list[bytes], found: np.ndarray, places: np.ndarray, values: np.ndarray, shards: np.ndarray) -> Iterator[tuple]:
    """A first document's recurring windows for their shards: runs of words, windows that follow each other in one."""
    mine = places < len(found)
    mine[mine] = found[places[mine]] == values[mine]  # not of another row of this id
    for shard in np.unique(shards[mine]):
        at = np.sort(places[mine & (shards == shard)])
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            yield int(shard), True, doc_id, 0, 0, b" ".join(words[run[0] : run[-1] + WINDOW])


def pieces(size: int):
    """(shard, phrase, doc_id, version, place, words) of documents: their phrases, and each of their blocks for each of the shards it must be streamed through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, version, text, places, values, owned, which, shards in zip(batch.doc_id, batch.version, batch.text, batch.places, batch["values"], batch.owned, batch.which, batch.shards):
                data = text.encode("utf-8", "replace")
                words, out, made = split(data), [], {}
                if places is not None:
                    out += phrases(doc_id, words, grams(word_hashes(data), WINDOW).astype(np.int64), np.asarray(places), np.asarray(values), np.asarray(owned))
                for block, shard in zip(*((which, shards) if which is not None else ((), ()))):
                    if block not in made:
                        made[block] = b" ".join(words[block * size : (block + 1) * size + WINDOW - 1])
                    out.append((int(shard), False, doc_id, version, int(block) * size, made[block]))
                yield pd.DataFrame(out, columns=["shard", "phrase", "doc_id", "version", "place", "words"])

    return run


def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards sorted by (key, phrases first): (doc_id, version, start, stop) of the words that occurrences of earlier documents' phrases cover."""
    for rows in whole_keys(batches, "key"):
        edge = edges_of(rows.key.to_numpy())
        for a, b in zip(edge, edge[1:]):
            part = rows.iloc[a:b]
            ids: dict[bytes, int] = {}
            phrase = part.phrase.to_numpy()
            if phrase.all() or not phrase.any():
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for doc_id, words in zip(part.doc_id[phrase], part.words[phrase]):
                row = tuple(ids.setdefault(w, len(ids) + 1) for w in words.split(b" "))
                for at in range(len(row) - WINDOW + 1):
                    key = row[at : at + WINDOW]
                    if automaton.get(key, doc_id) >= doc_id:
                        automaton.add_word(key, doc_id)
            automaton.make_automaton()
            docs, versions, starts, stops = [], [], [], []
            for doc_id, version, place, words in zip(part.doc_id[~phrase], part.version[~phrase], part.place[~phrase], part.words[~phrase]):
                stop = -1
                for end, owner in automaton.iter(tuple(ids.get(w, 0) for w in words.split(b" "))):
                    if owner < doc_id:
                        low, high = place + end - WINDOW + 1, place + end + 1
                        if low <= stop:
                            stops[-1] = high
                        else:
                            docs.append(doc_id)
                            versions.append(version)
                            starts.append(low)
                            stops.append(high)
                        stop = high
            yield pd.DataFrame({"doc_id": docs, "version": versions, "start": starts, "stop": stops}, dtype="int64")


def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with the runs to remove: (doc_id, version, n_removed, stripped_sha256)."""
    for batch in batches:
        rows = []
        for doc_id, version, text, runs in zip(batch.doc_id, batch.version, batch.text, batch.runs):
            words = split(text.encode("utf-8", "replace"))
            gone = np.zeros(len(words), dtype=bool)
            for run in runs:
                gone[run["start"] : run["stop"]] = True
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((doc_id, version, int(gone.sum()), sha(kept)))
        yield pd.DataFrame(rows, columns=["doc_id", "version", "n_removed", "stripped_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row per row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    row = ["doc_id", "version"]  # rows alike in both are one document
    known = cut(docs.mapInPandas(summaries, "doc_id bigint, version bigint, n_words bigint, text_hash bigint, kept_sha256 string, prints array<bigint>"))
    # a document with the words of a smaller one loses all that any window covers: everything
    firsts = known.where(f"n_words >= {WINDOW} and doc_id is not null").groupBy("text_hash", "kept_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = cut(firsts.where("first < last").drop("last"))  # few, and dealt by the join alone, which can then split a large class
    copies = known.drop("prints").join(firsts, ["text_hash", "kept_sha256"], "left")
    out = cut(copies.withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("text_hash", "first"))
    # copies share their hash, so a fingerprint recurs if texts with different hashes have it
    prints = known.where("doc_id is not null").select(*row, "text_hash", F.explode("prints").alias("print"))
    shared = prints.groupBy("print").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high").select(apart("print"))
    prints = prints.drop("text_hash").join(shared, "print").groupBy(*row).agg(F.collect_set("print").alias("prints"))
    prints = prints.join(out.where("copy").select(*row).distinct(), row, "left_anti")
    # only these documents can lose a word or take one from another; all further steps read them from here
    prints = cut(prints)
    some = cut(docs.where("doc_id is not null").where(maybe_in(prints, "doc_id")).join(prints, row).dropDuplicates(row))
    hashes = cut(some.mapInPandas(window_hashes(BLOCK), "value bigint, doc_id bigint, place bigint"))
    some = some.drop("prints")
    recurring = hashes.groupBy("value").agg(F.min(F.struct("doc_id", "place")).alias("o"), F.max("doc_id").alias("last")).where("o.doc_id < last")
    recurring = cut(recurring.select("value", "o.*"))
    shards = recurring.count() // SHARD + 1
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.floor(F.col("place") / STRETCH)), F.lit(shards)))
    theirs = recurring.groupBy("doc_id").agg(F.collect_list(F.struct("place", "value", "shard")).alias("w"))
    theirs = theirs.select("doc_id", F.col("w.place").alias("places"), F.col("w.value").alias("values"), F.col("w.shard").alias("owned"))
    # a block goes to every shard that has a phrase of a smaller document with the hash of one of its windows
    routes = hashes.select("value", "doc_id", F.floor(F.col("place") / BLOCK).alias("block"))
    routes = routes.join(recurring.select("value", "shard", F.col("doc_id").alias("least")), "value").where("least < doc_id")
    routes = cut(routes.select("doc_id", "block", "shard").distinct())
    # a shard that many blocks need is copied, and the blocks are dealt over the copies
    copies = routes.groupBy("shard").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("copies")).select(apart("shard"), "copies")
    routes = routes.groupBy("doc_id").agg(F.collect_list(F.struct("block", "shard")).alias("w")).select("doc_id", F.col("w.block").alias("which"), F.col("w.shard").alias("shards"))
    rows = some.join(theirs.join(routes, "doc_id", "full"), "doc_id").mapInPandas(pieces(BLOCK), "shard bigint, phrase boolean, doc_id bigint, version bigint, place bigint, words binary")
    to = F.when(F.col("phrase"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64(*row, "place"), "copies").cast("int")))
    keyed = rows.join(F.broadcast(copies) if shards <= SHARDS else copies, "shard").select("*", F.explode(to).alias("copy"))
    keyed = keyed.select(F.xxhash64("shard", "copy").alias("key"), "phrase", *row, "place", "words")
    runs = dealt(keyed, "key", F.desc("phrase")).mapInPandas(locate, "doc_id bigint, version bigint, start bigint, stop bigint")
    runs = runs.groupBy(*row).agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    stripped = some.join(runs, row).mapInPandas(strip, "doc_id bigint, version bigint, n_removed bigint, stripped_sha256 string")
    out = out.join(stripped, row, "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(sha([]))).otherwise(F.coalesce("stripped_sha256", "kept_sha256"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


PASSAGES_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as k from d where len(w) >= {WINDOW}),
x as (select doc_id, k, md5(array_to_string(w[k:k + {WINDOW - 1}], ' ')) as h from p),
c as (select doc_id, k from x join (select h, min(doc_id) as first from x group by h) using (h) where first < doc_id),
r as (select distinct doc_id, unnest(range(k, k + {WINDOW})) as at from c),
m as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as at from d where doc_id in (select doc_id from c)),
s as (select m.doc_id, count(r.at) as n_removed, coalesce(string_agg(case when r.at is null then word end, ' ' order by m.at), '') as kept from m left join r on m.doc_id = r.doc_id and m.at = r.at group by m.doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) as kept_sha256 from d left join s using (doc_id)
"""
