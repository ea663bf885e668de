"""From documents to token ids: rejects, repeated lines, near copies and benchmark text go, then the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as
Parquet and read again as the docs of the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, common, decontaminate, lines, quality, simhash
from tidemark.plans.lineage import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier, fitted on labels, accepts.

    Rows with null or empty text go.  Repeated rows are judged alike, null ids don't matter, ties at the threshold stay.
    """
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each line at its first place in the corpus only; near copies keep the lines that they share with each other.

    They keep them so that the next stage finds and drops all but one of them whole, instead of leaving what is not shared as a text
    of its own.  A row that loses all lines stays with an empty text, a null one stays null; of equal lines
    the one of the lowest doc_id (null last) is first; rows that repeat id and text stay alike.
    """
    return lines.dedup_lines(docs, copies=simhash.copies(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the lowest doc_id (null last).

    Rows without words, null and empty texts among them, stay; of rows that repeat id and text one does.
    """
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that share no passage with a benchmark item.

    Null, empty and short texts stay, as do null ids; repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with ids, n_tokens and whether decoding gives the text back.

    A null text has nulls, an empty one no ids.  Columns that docs has by these names, in any case, are replaced.
    """
    return bpe.encode(docs)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("encode", encode)]

#: SQL has neither the classifier, SimHash nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents after all stages."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
