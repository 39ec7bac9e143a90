"""From raw documents to token ids, stage by stage.

Each stage works on all rows that the one before it kept; its result is written as Parquet in the shared folder and
read again, so a lost executor costs no earlier stage.

Defined results: null, empty and very short texts fail the quality rules and go; texts are never cut short, however long;
of exactly repeated rows all pass the rules, and near copies then leave the rows of one doc_id (repeats of one row have
one doc_id and stay together); rows without a doc_id count as one id; an empty table gives an empty one; columns beyond
those of documents are handed on until the tokens. After decontamination the words on both sides of a cut become
neighbours, and that text is not matched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from tidemark.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; toxic words of each language are learnt from a sample of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.rules_for(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the largest doc_id only."""
    return line_dedup.without_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.representatives(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that match a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return bpe.tokenized(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", benchmarks),
    ("byte_bpe", tokens),
]

#: Near-duplicate components and byte-pair merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
