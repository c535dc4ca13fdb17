"""A training-data pipeline over `documents`: reject toxic texts, drop exact then near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents. Mixing drops no document: its budget is the
least at which each source is passed once, and small sources are passed up to twice, so their rows repeat.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import exact, minhash, mixing, packing, toxicity
from lumenfold.llm.scratch import shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below the threshold. Null and empty texts get the intercept's score; rows that repeat a doc_id are judged each; an empty table stays empty."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (without white space; null is empty) the longest, then that of the smallest doc_id; of rows that repeat it, one."""
    return exact.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id. Rows without words (null, empty, blank) all stay."""
    return minhash.keep_one_of_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once or twice; a null source is the source ''. Rows with a null text count one token, and repeated rows each count."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece. A null or empty text is its end token alone; rows that repeat a doc_id are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, MinHash and tokenizer can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
