"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data and the final mix, over all documents.

Its end is the corpus: the documents that the stages keep, with their masked texts, and how often the mix repeats each.

Cases, stage by stage (each module's docstring has the rest): a null or empty text gets the share of good labels as its score, shingles and
leaks it has none, nothing is masked in it, and it counts 0 words; documents without a doc_id stay through near duplicates;
rows that repeat a doc_id are judged each, but near duplicates keep them or drop them together; empty tables give empty stages; further
columns of documents stay to the end, but for those that the mix adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard, mixing, pii, quality
from lodestone.llm.common import shared_dir, table

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("mix", mixing.stage),
]

#: Training a classifier, a tagger and a join by sampled paths can't be put in SQL; tests/llm compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder and read again."""
    from uuid import uuid4

    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
