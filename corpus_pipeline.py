"""Corpus pipeline: quality rules, near-duplicate removal, mixing and packing of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.jaccard import keep_one
from quillon.llm.mixing import take_mix
from quillon.llm.packing import pack_documents
from quillon.llm.quality import keep_good
from quillon.llm.queries import vocabulary
from quillon.llm.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all columns.

    Null, empty and blank texts and those of under 20 words go; a long text is judged whole; repeated rows and rows
    with null ids are each judged by their text; an empty table stays empty; extra columns of any name pass through.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of the smallest id, with all columns.

    Null ids come last; of repeated rows, and of ties on the id, one stays; texts without words are in no group and
    stay; whole texts are compared; an empty table stays empty; extra columns of any name pass through.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all columns.

    A document comes 0 to 2 times. A null text has no words; a null source is the last source; documents of one
    source and hash (equal ids, null ids) are taken alike; an empty table stays empty; extra columns pass through.
    """
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: the rows of pack_documents, without the columns of documents.

    A null or empty text is its end id alone; null ids stay null; a document that the mix took twice is packed
    twice; a long text is cut over sequences; an empty table gives no rows; extra columns are left behind.
    """
    return pack_documents(docs, vocabulary(), end_id=2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Compression ratios and token ids can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the folder's documents; each stage reads the table its predecessor wrote, so a
    lost executor costs the stage's own lost tasks. Nulls, repeats, empties and extra columns: as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
