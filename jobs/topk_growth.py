"""Keeps the exact Top-K of a fixed set of query vectors while the library grows.

    python -m jobs.topk_growth jobs/topk_growth.json --queries PATH --library PATH --out PATH [--checkpoint PATH]

The library is a folder of Parquet files, read as a file stream: each run takes the files that no earlier run has
taken and ends. Only new vectors are searched; their Top-K is merged with what is kept. The Top-K after batch N is the
table version=N, partitioned by query; a batch that is repeated after a failure reads version N - 1 and writes the same
version N again. The query set is that of the first run and is kept below `out`. A vector that comes again
unchanged counts once; a changed vector needs a new library_index. Vectors that are null or not finite are left out.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenfold.operators import retrieve
from lumenfold.schemas import TOPK
from lumenfold.sources import cache

log = logging.getLogger("topk_growth")
DEFAULTS = {"key": "vec_id", "vector": "embedding", "k": 10, "query_filter": None, "library_filter": None, "files_per_batch": None, "parts": 8}


def kept_queries(spark: SparkSession, path: str, out: str, s: dict) -> DataFrame:
    """The query vectors of the first run."""
    held = f"{out}/queries"
    if not cache.exists(spark, held):
        rows = spark.read.parquet(path).where(s["query_filter"] or "true").select(F.col(s["key"]).alias("query_index"), F.col(s["vector"]).alias("embedding"))
        rows.write.mode("overwrite").parquet(held)
    queries = spark.read.parquet(held)
    log.info("queries: %d of %s", queries.count(), path)
    return queries


def merged(prior: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    rows = new.select("query_index", "library_index", "similarity")
    if prior is not None:
        rows = prior.select(*rows.columns).unionByName(rows).dropDuplicates(["query_index", "library_index"])
    order = Window.partitionBy("query_index").orderBy(F.desc("similarity"), "library_index")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """query_index, rank, library_index, similarity of the newest version; no rows before the first."""
    folder = f"{out}/topk"
    if not cache.exists(spark, f"{folder}/version=0"):
        return spark.createDataFrame([], TOPK)
    number = spark.read.schema(f"{TOPK}, version int").parquet(folder).agg(F.max("version").alias("n")).first().n
    return spark.read.schema(TOPK).parquet(f"{folder}/version={number or 0}").drop("part")


def run(spark: SparkSession, queries_path: str, library_path: str, out: str, checkpoint: str | None = None, **settings) -> DataFrame:
    s = DEFAULTS | settings
    out, k = out.rstrip("/"), int(s["k"])
    queries = kept_queries(spark, queries_path, out, s)

    def grow(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        new = retrieve.topk_cosine(queries, batch, k)
        prior = spark.read.schema(TOPK).parquet(f"{out}/topk/version={number - 1}") if number else None
        rows = merged(prior, new, k).withColumn("part", F.pmod(F.col("query_index"), F.lit(int(s["parts"]))))
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/topk/version={number}")
        log.info("batch %d: %d library vectors, wrote %s/topk/version=%d", number, batch.count(), out, number)
        batch.unpersist()

    source = spark.readStream.schema(spark.read.parquet(library_path).schema)
    if s["files_per_batch"]:
        source = source.option("maxFilesPerTrigger", int(s["files_per_batch"]))
    library = source.parquet(cache.stream_path(spark, library_path)).where(s["library_filter"] or "true").select(F.col(s["key"]).alias("library_index"), F.col(s["vector"]).alias("embedding"))
    stream = library.writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in stream.recentProgress), library_path, sum(p["numInputRows"] > 0 for p in stream.recentProgress))
    rows = latest(spark, out)
    log.info("%d rows in %s/topk", rows.count(), out)
    return rows


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    for name in ("queries", "library", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--checkpoint")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("topk_growth").getOrCreate()
    try:
        run(spark, args.queries, args.library, args.out, args.checkpoint, **cache.load_json(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
