"""A corpus made ready for training: five stages, each an operator of riskloom.llm.

Each stage works on all that the one before kept, and what it decides takes effect.
All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, small_batches, table
from riskloom.llm.decontaminate import without_leaks
from riskloom.llm.linededup import dedup_lines
from riskloom.llm.packing import pack
from riskloom.llm.simhash import verified_duplicates
from riskloom.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).where("toxicity < 0.5").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one; every document stays, and a text
    that had nothing else is empty."""
    small_batches(spark)
    out = dedup_lines(docs, carry=["lang", "source"])
    return out.select("doc_id", "text", "carried.*", F.length("text").cast("long").alias("n_chars")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group; rows without a doc_id
    stay."""
    small_batches(spark)
    groups = verified_duplicates(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item."""
    small_batches(spark)
    return without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences."""
    small_batches(spark)
    return pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A classifier, a set-similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
