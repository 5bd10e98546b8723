"""A corpus pipeline: quality classifier, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import exact_dedup, jaccard, mixing, packing, quality
from voxframe.functions.scratch import Tables
from voxframe.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, judged by their own texts; null and empty texts count as empty, null ids stay or go by their texts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id; null and empty texts are equal. Of rows that repeat id and text one stays."""
    return exact_dedup.keep_last_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more), the document with the smallest id.

    Rows without words link with nothing and stay, as do rows with a null id; rows that repeat an id share its fate.
    """
    return jaccard.keep_first_of_groups(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns, in the order in which the sources are to be read; a null source is a source of its own."""
    return mixing.mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, in the order of the mixture; null and empty texts are the closing token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The classifier's scores have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; its table goes when the next one is written."""
    docs, work = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if k:  # the stage before has been read for the last time
            work.drop(STAGES[k - 1][0])
    return docs
