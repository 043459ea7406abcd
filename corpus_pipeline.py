"""A corpus pipeline of five stages; each works on what the stage before it has written.

Quality rules remove failing lines and reject documents; of each group of near-duplicates the document with the
smallest id stays; documents that hold a benchmark item go; personal data is replaced by its kind in brackets; what is
left is encoded. No stage drops rows in any other way, and a null id never matches another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, decontam, jaccard_join, pii, quality, sp_codec


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, without their failing lines."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of texts that link at 80 % or more."""
    classes = jaccard_join.jaccard_classes(docs.select("doc_id", "text"))
    gone = common.save(classes.where("id <> component").select(F.col("id").alias("doc_id")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if common.small(gone, 32) else gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every personal span replaced."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the original byte spans of the pieces."""
    return sp_codec.encode_documents(docs).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]

#: The span classifier of stage 4 and the piece encoder of stage 5 have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.save(docs, "stage")
    return docs
