"""A corpus through five stages: good documents, one of each near-duplicate group, no personal data, the wanted mix, packed.

Every stage takes (spark, docs, sf_dir) and the columns of ``docs``, whatever further ones there are, and all but the
last return them unchanged. What holds for all stages: any column may be null; rows may repeat; an empty table gives
an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, packing, pii, quality
from quillon.llm.shared import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored like any other (by its structure alone), rows without an id too; equal texts share
    their fate. Labels of ids that ``docs`` lacks, without an id or without a quality teach nothing; without labels
    of both classes all documents have one score, and stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: that with the smallest id.

    Texts without words (or null) link with nothing and stay. Rows that repeat an id and its text become one; rows that
    share an id but not the text stay or go together. Rows without an id link too and go before those with one."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by marks, all rows kept; n_chars, if there is one, follows the text (null: null).

    A null text stays null; equal texts are redacted alike; overlapping spans get one mark, the first's."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it.

    A null source is a source of its own. A document without words adds none to the mix but is taken at its source's
    rate like others; of a source without any words nothing is taken. Rows with the same id and source share a draw."""
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths: a row a piece, copies of a document being pieces of their own.

    A document without words is one piece of length 0 without a bin; ids may be null or repeat."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Hashed features, trained trees and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
