"""Finds the documents closest to each passage: cosine Top-K of sparse word-count vectors.

    python -m jobs.passage_search jobs/passage_search.json --documents PATH --passages PATH --out PATH

A text is a sparse vector with a bin for each word, as a spectrum is one with a bin for each range of m/z. Words are
`[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Documents are read once: a document's words are counted and its norm is
summed in its row, and of its words only those that a passage has are kept and searched, by the library's sparse Top-K.
Matches below `least` are left out. Output is partitioned by the document's language; a run writes the whole output
again, so runs over the same tables give the same rows. Null and empty texts match nothing; keys must be unique.
"""

from __future__ import annotations

import argparse
import logging
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from lumenfold.operators import retrieve
from lumenfold.sources import cache

log = logging.getLogger("passage_search")
DEFAULTS = {"k": 5, "least": 0.1, "document_key": "doc_id", "passage_key": "item_id", "text": "text", "lang": "lang"}
LOW = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), *LOW), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and word: key, the norm over all of the text's words, word, its count. Bytes lower only A-Z and split at [\\x20\\x09-\\x0D]."""
    for b in batches:
        for first in range(0, b.num_rows, 500):
            keys, texts = (c.slice(first, 500) for c in b.columns)
            found = [Counter(t.lower().split()) for t in texts.to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(c) for c in found])
            norms = np.array([math.sqrt(sum(n * n for n in c.values())) for c in found])
            columns = [keys.take(pa.array(at)), pa.array(norms[at]), pa.array([w for c in found for w in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[b.schema.names[0], "norm", "word", "n"])


def vectors(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """rows: key, text. Gives key, bin, value over the vocabulary's words; the norm is over all words."""
    texts = rows.select(key, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = StructType([texts.schema[0], StructField("norm", DoubleType()), StructField("word", BinaryType()), StructField("n", LongType())])
    found = texts.mapInArrow(counted, kind).withColumn("word", F.col("word").cast("string")).join(vocabulary, "word")
    return found.select(key, "bin", (F.col("n") / F.col("norm")).alias("value"))


def run(spark: SparkSession, documents_path: str, passages_path: str, out: str, **settings) -> DataFrame:
    s = DEFAULTS | settings
    out = out.rstrip("/")
    documents = spark.read.parquet(documents_path).select(F.col(s["document_key"]).alias("library_index"), F.col(s["text"]).cast("string").alias("text"), F.coalesce(F.col(s["lang"]).cast("string"), F.lit("")).alias("lang"))
    passages = spark.read.parquet(passages_path).select(F.col(s["passage_key"]).alias("query_index"), F.col(s["text"]).cast("string").alias("text"))
    # numbers of the passages' words, written so that they stay the same
    numbered = passages.select(F.explode(words(F.col("text"))).alias("word")).distinct().withColumn("bin", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{out}/vocabulary")
    vocabulary = spark.read.parquet(f"{out}/vocabulary")
    log.info("%d passages of %s with %d words", passages.count(), passages_path, vocabulary.count())
    vectors(documents, vocabulary, "library_index").write.mode("overwrite").parquet(f"{out}/vectors")
    library = spark.read.parquet(f"{out}/vectors")
    found = retrieve.topk_sparse(vectors(passages, vocabulary, "query_index"), library, int(s["k"])).where(F.col("similarity") >= float(s["least"]))
    rows = found.join(documents.select("library_index", "lang"), "library_index")
    # an empty name can't be a partition's
    rows = rows.select(F.col("query_index").alias("item_id"), "rank", F.col("library_index").alias("doc_id"), F.round("similarity", 6).alias("similarity"), F.when(F.col("lang") != "", F.col("lang")).alias("lang"))
    rows.repartition("lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/matches")
    log.info("%d vector entries of %s", library.count(), documents_path)
    rows = matches(spark, out)
    log.info("wrote %d matches to %s/matches", rows.count(), out)
    return rows


def matches(spark: SparkSession, out: str) -> DataFrame:
    schema = "item_id long, rank long, doc_id long, similarity double, lang string"
    return spark.read.schema(schema).parquet(f"{out}/matches").na.fill("", ["lang"])


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    for name in ("documents", "passages", "out"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("passage_search").getOrCreate()
    try:
        run(spark, args.documents, args.passages, args.out, **cache.load_json(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
