"""The corpus pipeline: toxic documents go, of near duplicates one stays,
repeated spans are cut out, documents that leak benchmark items go, and the
rest is packed into sequences of tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; :func:`run` writes every stage's result to the shared folder
and reads it back for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, packing, spans, toxicity
from tessera.llm.common import durable, table
from tessera.llm.queries import tokenizer
from tessera.session import apply_library_conf

#: Similarity from which documents are near duplicates, on runs of five words.
WORDS, PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (column id)."""
    return docs.join(ids.withColumnRenamed("id", "_dropped_doc_id"), F.col("doc_id") == F.col("_dropped_doc_id"), "left_anti")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go.  A doc_id that
    occurs with several texts goes if one of them does; rows without doc_id stay."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    bad = durable(scored.where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(),
                  "toxic")
    return _without(docs, bad)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; rows
    without doc_id stay."""
    found = neardup.near_duplicates(docs, words=WORDS, percent=PERCENT)
    lost = durable(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(),
                   "near-duplicates")
    return _without(docs, lost)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in any but the first of equal spans are cut out."""
    return spans.remove_repeats(docs, report=False).select(*docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go; rows without doc_id stay."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = durable(found.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "leaks")
    return _without(docs, bad)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their token ids."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("substring_dedup", repeats_out),
    ("decontamination", leaks_out),
    ("packing", packed),
]

# SQL cannot express the learned scores, so the stages are tested against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    apply_library_conf(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
