"""Word clouds: most frequent words and neighbouring pairs of words, with sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.session import cut

#: Words that a cloud leaves out; a caller gives its own list, and lemmas by a map.
STOP = (
    "the and for are was were with that this from have has had not but you your they their there which who what when where will would can could about into than then them these those his her its our out "
    "les des une est dans pour que qui sur avec pas par aux ses son der die das und ist nicht ein eine mit von auf den dem des sie wir ihr que los las una por con para del"
).split()
#: Terms of the cloud; terms looked at for rare pairs, as a multiple of that; the least count of a pair.
TERMS, LOOKED_AT, PAIR = 100, 3, 5


def lemmas(text: Column, lemma: dict[str, str] | None) -> Column:
    found = words(text)
    if not lemma:
        return found
    names = F.create_map(*[F.lit(x) for kv in lemma.items() for x in kv])
    return F.transform(found, lambda w: F.coalesce(F.try_element_at(names, w), w))


def plain(stop) -> Callable[[Column], Column]:
    """Whether a word isn't a stop word."""
    return lambda w: ~w.isin(*stop)


def pairs(found: Column, stop) -> Column:
    """Pairs that are neighbours before stop words are left out."""
    ok = plain(stop)
    both = F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(ok(a) & ok(b), F.concat_ws(" ", a, b)).otherwise(""))
    return F.filter(F.slice(both, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), lambda x: x != "")


def counted(texts: DataFrame, terms: Column) -> DataFrame:
    return texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def unigrams(texts: DataFrame, text: str = "content_text", stop=STOP, lemma=None) -> DataFrame:
    return counted(texts, F.filter(lemmas(F.col(text), lemma), plain(stop)))


def bigrams(texts: DataFrame, text: str = "content_text", stop=STOP, lemma=None) -> DataFrame:
    return counted(texts.select(lemmas(F.col(text), lemma).alias("w")), pairs(F.col("w"), stop))


def stems_of(words: DataFrame, stem: Callable[[Column], Column], stop=STOP) -> DataFrame:
    """(word, stem) of the distinct rows of `words` (word), each stemmed once. Words whose stem is a stop word are left out."""
    tasks = words.sparkSession.sparkContext.defaultParallelism  # few bytes and much work: by its size Spark would make few tasks of it
    return cut(words.distinct().repartition(tasks, "word").select("word", F.explode(F.filter(F.array(stem(F.col("word"))), plain(stop))).alias("stem")))


def stemmed(terms: DataFrame, stem: Callable[[Column], Column], stop=STOP, words: DataFrame | None = None) -> DataFrame:
    """`terms` (term, n), words and pairs, by the stems of their words, which `words` (word) has if given. Terms with a stem that is a stop word go.

    Stems are joined to the terms: a word stands in many pairs, but is stemmed once.
    """
    known = stems_of(terms.select(F.explode(F.split("term", " ")).alias("word")) if words is None else words, stem, stop)
    parts = F.split("term", " ")
    rows = terms.select(F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.size(parts) - 1).alias("b"), (F.size(parts) > 1).alias("pair"), "n")
    rows = rows.join(known.select(F.col("word").alias("a"), F.col("stem").alias("first")), "a").join(known.select(F.col("word").alias("b"), F.col("stem").alias("second")), "b")
    return rows.groupBy(F.when(F.col("pair"), F.concat_ws(" ", "first", "second")).otherwise(F.col("first")).alias("term")).agg(F.sum("n").alias("n"))


def cloud(texts: DataFrame, text: str = "content_text", most: int = TERMS, stop=STOP, lemma=None, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, n, size, opacity). Of the first 3 * `most` terms rare pairs go, then the first `most` stay; sizes are 14 to 48."""
    found = texts.select(lemmas(F.col(text), lemma).alias("w"))
    every = counted(found, F.concat(F.filter("w", plain(stop)), pairs(F.col("w"), stop)))  # words and pairs in one pass
    every = stemmed(every, stem, stop, found.select(F.explode(F.filter("w", plain(stop))).alias("word"))) if stem else every
    order = [F.desc("n"), F.asc("term")]
    top = every.orderBy(*order).limit(LOOKED_AT * most).where(~F.col("term").contains(" ") | (F.col("n") >= PAIR)).orderBy(*order).limit(most)
    w = Window.partitionBy(F.lit(1))  # over `most` rows
    share = (F.col("n") - F.min("n").over(w)) / F.greatest(F.max("n").over(w) - F.min("n").over(w), F.lit(1))
    return top.select("term", "n", (14 + F.floor(share * 34)).cast("long").alias("size"), F.round(0.55 + 0.45 * share, 6).alias("opacity"))
