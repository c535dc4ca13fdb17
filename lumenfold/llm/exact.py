"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest. New data comes in batches. A batch is reduced to one
row per digest (partial aggregation first, so a group of copies costs a row per task) and joined to the index by
sort-merge without moving the index: an anti-join finds what is new, which is appended; what the index holds
already is appended to a second table of the same buckets, so that group sizes and the rows that stay are those of
all batches so far. Each append adds a file to a bucket; compact() writes an index of one sorted file a bucket. The number of buckets is set when an index is made (by the rows of its first batch, unless
given) and kept beside it. One writer at a time; a batch that was cut off can be absorbed into a new index only.

Null and empty texts are both the empty text and so copies of each other. Of equal texts the row with the
most code points in its original stays, then the smallest doc_id (a null doc_id counts as smallest). Rows
that repeat a doc_id and its text share that document's decision; keep_distinct() keeps one of them. Rows of one
doc_id with different texts are decided each by its text. Very long texts are digested whole. An empty table gives
no rows. Other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch, chosen

SPACES = " \t\n\x0b\x0c\r"
#: Least buckets of an index, and rows of the first batch for each bucket beyond; batches that one call is absorbed in.
BUCKETS, BUCKET_ROWS, BATCHES = 48, 1 << 21, 2
ROW = "digest BINARY, n BIGINT, keep_id BIGINT, group_size BIGINT"


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))  # by bytes, faster than translate()
    return F.unhex(F.sha2(bare, 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, code points of the text."""
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


def merged(rows: DataFrame, size: Column) -> DataFrame:
    """One row per digest: code points and doc_id of the row that stays, and the group's size."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "keep_id"))
    rows = rows.groupBy("digest").agg(best.alias("best"), size.alias("group_size"))
    return rows.select("digest", (-F.col("best.n")).alias("n"), "best.keep_id", "group_size")


class DigestIndex:
    """A persistent set of digests with the document that stands for each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, name = spark, path, f"digest_index_{uuid.uuid4().hex}"
        noted = f"{path}.buckets"
        spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("n")).write.mode("ignore").parquet(noted)
        self.buckets = spark.read.schema("n int").parquet(noted).first().n
        self.first, self.again = name, f"{name}_again"
        for table, where in ((self.first, path), (self.again, f"{path}.again")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ROW}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def append(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(table)
        self.spark.catalog.refreshTable(table)

    def absorb(self, batch: DataFrame, scratch: Scratch) -> None:
        """batch: doc_id, digest, n. Appends the digests that the index lacks, and the batch's part of the others."""
        mine = merged(batch.select("digest", "n", F.col("doc_id").alias("keep_id")), F.count("*"))
        if self.spark.table(self.first).isEmpty():
            return self.append(mine, self.first)
        mine = scratch.keep(mine, "batch")
        known = self.spark.table(self.first).select("digest").hint("merge")
        # the anti-join reads the table that is appended to, so what else the batch holds is appended first
        self.append(mine.join(known, "digest", "left_semi"), self.again)
        self.append(mine.join(known, "digest", "left_anti"), self.first)

    def compact(self, path: str) -> DigestIndex:
        """The same digests as a new index of one sorted file a bucket, in which what later batches added is merged."""
        new = DigestIndex(self.spark, path, self.buckets)
        new.append(self.read(), new.first)
        return new

    def read(self) -> DataFrame:
        """digest, n, keep_id, group_size over all batches; the buckets serve the aggregation and the join, nothing is moved."""
        more = merged(self.spark.table(self.again), F.sum("group_size")).select("digest", F.col("n").alias("m"), F.col("keep_id").alias("id"), F.col("group_size").alias("size"))
        rows = self.spark.table(self.first).join(more.hint("merge"), "digest", "left")
        later = F.when(F.col("m").isNotNull(), F.struct((-F.col("m")).alias("n"), F.col("id").alias("keep_id")))
        best = F.least(F.struct((-F.col("n")).alias("n"), "keep_id"), later)
        rows = rows.select("digest", best.alias("best"), (F.col("group_size") + F.coalesce("size", F.lit(0))).alias("group_size"))
        return rows.select("digest", (-F.col("best.n")).alias("n"), "best.keep_id", "group_size")

    def forget(self) -> None:
        """Removes the names from this session; the files stay."""
        for table in (self.first, self.again):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def decide(docs: DataFrame, index_path: str | None, buckets: int | None, batches: int) -> tuple[DataFrame, DataFrame]:
    """The digests of docs, and the index's rows after all batches."""
    s = Scratch(docs.sparkSession)
    mine = s.keep(digests(docs), "digests")
    index = DigestIndex(docs.sparkSession, index_path or s.path("index"), buckets or max(BUCKETS, -(-mine.count() // BUCKET_ROWS)))
    for k in range(batches):
        index.absorb(mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), s)
    # a table of its own, so that a join on a digest with very many copies can be split
    standing = s.keep(index.read(), "standing")
    index.forget()
    return mine, standing


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier data, keep_id may be an earlier document and group_size counts the earlier ones too.
    """
    mine, standing = decide(docs, index_path, buckets, batches)
    return mine.join(standing.drop("n"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Of the rows of docs with equal texts the one that exact_dedup() keeps; of rows that repeat its doc_id too, one."""
    _, standing = decide(docs.select("doc_id", "text"), None, None, batches)
    return chosen(docs, digest(F.col("text")), standing.select(F.col("digest").alias("key"), F.col("keep_id").alias("doc_id")))
