"""The corpus pipeline: documents without toxic ones, copies, near copies and repeated passages, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the
columns of documents, extra ones included, whatever these are called. An empty table stays empty at every stage. SQL can't express its models
and min-hashes, so ORACLE_SQL is None; tests/llm holds what each stage keeps against brute force or the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from proofline.llm.shared import checked, table, written
from proofline.shipping import ship

ORACLE_SQL = None

def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, trained on the labels, do not predict to be toxic (the operator's threshold). Null and empty
    texts are scored like others; without labels of both classes all stay."""
    return toxicity.accepted(docs, toxicity.train(docs, table(ship(spark), sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id. Null and empty texts are equal; a null id gives way to others."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id. Rows without an id and texts without words stay,
    and rows that repeat an id stay or go together."""
    found, _ = ngram_join.ngram_join(docs)
    gone = checked(written(found.where("class_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "near"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut from all but the earliest document that has them; documents of which nothing is left go. Rows without an id stay as they are."""
    return substring_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with their sequences; null and empty texts are one end id each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
