"""The corpus pipeline: stages that each take documents and return documents, and last their tokens.

Every stage works on all rows its predecessor kept. Near duplicates are told by five-word shingles at 80 %;
repeated lines follow their query's contract (keys of ten documents or more), but the first document keeps its
line, so that one of a group of copies goes on to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, decontaminate, line_dedup, minhash, quality_model
from quadrille.llm.text import read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs, quality_model.train(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that have nothing else."""
    return line_dedup.rewrite_lines(docs, min_docs=10, keep="first", chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the digests of ids and of the decoded bytes."""
    return bpe.digests(bpe.encode(docs, decoded=True), "ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the trained classifier. The tests hold the lines, near duplicates, benchmark and tokens stages
#: against brute force on the rows they were given, the classifier's against its own scores, and run() against the
#: stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written, and the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
