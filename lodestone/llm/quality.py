"""Quality by nearest-neighbour voting in a latent semantic space.

A text has two kinds of terms. Its words, in lower case and hashed to a fixed number of columns, are weighed by log count and inverse
document frequency; its form is told by pairs of neighbouring byte classes (letters by case, digits, each common mark, white space) and
a few word statistics. A bounded sample of labelled documents gives the weights, a truncated singular value decomposition of
either table, and the labelled vectors, which are broadcast. A vector is both latent vectors, each of unit length, side by side,
so a cosine is the weighed mean of theirs. Every document's cosine with each labelled vector is computed exactly, in
blocks of one shape, and its nearest neighbours, and all that are as near as the last of them (to five digits), vote with their similarity.

Cases: null and empty texts get the vector of no terms, hence the share of label 1; without any labelled row all scores are 0.5;
null labels are ignored; rows that repeat a doc_id, label and text count once in the sample and are scored each; a null doc_id is not held
out; other columns stay as they are, but score() puts its own in the place of columns `score` and `predicted`; stage() changes none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.wordhash import word_hashes

#: The labelled rows that are fitted and broadcast at most: those with the smallest digest of their ids.
LABELLED, RANK, NEIGHBOURS, ACCEPT, FOLDS = 4096, 32, 24, 0.3, 5
#: Columns that words are hashed to, and the share of the words in a cosine; the rest is the form's.
COLUMNS, LEXICAL = 2048, 0.3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
BLOCK = 512


def byte_classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)  # 0: controls
    kinds[[9, 10, 11, 12, 13]], kinds[32] = 1, 2
    kinds[48:58], kinds[65:91], kinds[97:123] = 3, 4, 5
    kinds[0x80:0xA0], kinds[0xA0:0xC0], kinds[0xC0:] = 4, 5, 6  # Latin letters: a lead byte, then capitals before small letters
    for i, mark in enumerate(MARKS):
        kinds[mark] = 7 + i
    return kinds


KINDS = byte_classes()
N_KINDS = 7 + len(MARKS)
N_TERMS = N_KINDS * N_KINDS + 8


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a text's words, each once and in order, and one more than the log of their counts."""
    column, count = np.unique((word_hashes((text or "").lower().encode("utf-8", "replace")) % np.uint64(COLUMNS)).astype(np.uint16), return_counts=True)
    return column, (1 + np.log(count)).astype(np.float32)


def table_of(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(found), COLUMNS), dtype=np.float32)
    for row, (column, weight) in zip(out, found):
        row[column] = weight
    return out


def terms(text: str | None) -> np.ndarray:
    """The form of one text: how often each pair of classes comes in a thousand bytes, and word statistics, on a log scale."""
    out = np.zeros(N_TERMS, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return out
    kinds = KINDS[np.frombuffer(data, dtype=np.uint8)].astype(np.int32)
    pairs = np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    out[:-8] = np.log1p(pairs * (1000.0 / len(kinds)))
    n, lines = len(words), text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:]))
    out[-8:] = np.log1p(100 * same / n), np.log1p(100 * len(set(words)) / n), np.log1p(n), np.log1p(len(data) / n), np.log1p(10 * len(set(lines)) / len(lines)), np.log1p(100 * len(lines) / n), np.log1p(max(map(len, words))), 1.0
    return out


def leading_axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    wide = min(rank + 16, *rows.shape)
    basis = rows @ np.random.default_rng(7).normal(size=(rows.shape[1], wide)).astype(np.float32)
    for _ in range(4):
        basis = rows @ (rows.T @ np.linalg.qr(basis)[0])
    return np.linalg.svd(np.linalg.qr(basis)[0].T @ rows, full_matrices=False)[2][:rank].T.astype(np.float32)


class Neighbours:
    """Labelled vectors and how to place a text among them."""

    def __init__(self, rows: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float64)
        if not len(labels):
            return
        self.mean, spread = rows.mean(0), rows.std(0)
        # terms that hardly vary would only add noise
        self.weight = np.where(spread > 0.02, 1 / (spread + 0.1), 0).astype(np.float32)
        centred = (rows - self.mean) * self.weight
        value, vector = np.linalg.eigh(centred.T @ centred)
        top = np.argsort(value)[::-1][: min(RANK, len(value))]
        self.axes = vector[:, top].astype(np.float32)
        lexical = table_of(words)
        self.rarity = (1 + np.log((1 + len(words)) / (1 + (lexical > 0).sum(0)))).astype(np.float32)
        lexical *= self.rarity  # in place: the table is the largest thing here
        lexical /= np.maximum(np.linalg.norm(lexical, axis=1, keepdims=True), 1e-12)
        self.middle = lexical.mean(0)
        lexical -= self.middle
        self.word_axes = leading_axes(lexical, RANK)
        del lexical
        self.vectors = np.vstack([self.placed(rows[at : at + BLOCK], words[at : at + BLOCK]) for at in range(0, len(rows), BLOCK)])

    def placed(self, rows: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        form = unit(((rows - self.mean) * self.weight) @ self.axes)
        lexical = unit((unit(table_of(words) * self.rarity) - self.middle) @ self.word_axes)
        return np.hstack([form * np.float32((1 - LEXICAL) ** 0.5), lexical * np.float32(LEXICAL**0.5)])

    def scores(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            part = [*texts[at : at + BLOCK]]
            padded = part + [None] * (BLOCK - len(part))  # products of one shape sum in one order
            rows = np.stack([terms(x) for x in padded])
            cosine = np.round(self.placed(rows, [words_of(x) for x in padded]) @ self.vectors.T, 5)
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, -k, None]
            weight = np.where(cosine >= least, np.maximum(cosine, 0).astype(np.float64) ** 4 + 1e-9, 0)
            score = np.clip((weight @ self.labels) / weight.sum(1), 0, 1)
            out[at : at + BLOCK] = np.where(rows.any(1), score, self.prior)[: len(part)]
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> Neighbours:
    """Fit on at most `most` labelled documents whose id isn't held out. Only terms of these reach the driver: 5.5 kB of form each, and 6 bytes a column."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out()).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "label").limit(most)

    def of(texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        return pd.DataFrame({"form": [terms(t).tobytes() for t in texts], "columns": [c.tobytes() for c, _ in words], "weights": [w.tobytes() for _, w in words]})

    # the sample's ids are broadcast: at most `most` rows
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))
    found = found.select("doc_id", "label", "digest", F.pandas_udf(of, "form binary, columns binary, weights binary")("text").alias("t")).select("doc_id", "label", "digest", "t.*")
    # an id may have many texts: each is one row, and no more than `most` of them are taken
    found = found.groupBy("doc_id", "label", "digest").agg(*[F.first(c).alias(c) for c in ("form", "columns", "weights")])
    rows = found.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "label", "digest").limit(most).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.digest or 0))  # the driver sums in one order
    form = np.stack([np.frombuffer(r.form, dtype=np.float32) for r in rows]) if rows else np.zeros((0, N_TERMS), dtype=np.float32)
    words = [(np.frombuffer(r.columns, dtype=np.uint16), np.frombuffer(r.weights, dtype=np.float32)) for r in rows]
    return Neighbours(form, words, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """`docs` and the columns score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    vote = F.pandas_udf(lambda x: pd.Series(shared.value.scores(x.tolist())), "double")
    return docs.withColumn("score", vote("text")).withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the vote accepts, as they are."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    vote = F.pandas_udf(lambda x: pd.Series(shared.value.scores(x.tolist())), "double")
    return docs.where(vote("text") >= ACCEPT)
