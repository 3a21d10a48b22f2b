"""A corpus pipeline: quality filter, near-duplicate removal, substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the
columns of documents. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wegloom.llm import common, minhash, packing, quality, substring_dedup


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null and empty texts are scored like any other, rows without doc_id are kept or rejected by their text, repeated rows
    fare alike; an empty table gives no rows. All columns of docs come out, whatever their names."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: five words, a similarity of 0.8.

    Texts without words and rows without doc_id stay; of rows of one doc_id each is judged by its own text; an empty table
    gives no rows. All columns come out."""
    return minhash.keep_first(docs, like=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that an earlier document has.

    A null text stays null, a text of fewer words as it is, and documents that lose all their words go; an empty table
    gives no rows. All columns come out."""
    return substring_dedup.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null or empty text is one token, its end; repeated rows and rows without doc_id are packed each; an empty table
    gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packed)]

#: SQL can express neither the classifier nor the packing; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
