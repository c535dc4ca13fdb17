"""The subpackage's registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import brown, divergence, exact, license_scan, media, minhash, mixing, packing, pii, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(f):
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": _documents(license_scan.license_scan),
    "op2_temperature_mixing": _documents(mixing.mix_table),
    "op3_best_fit_packing": _documents(packing.pack_documents),
    "op4_substring_dedup": _documents(substring.dedup_passages),
    "op5_toxicity": lambda spark, sf_dir: toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op6_warc": lambda spark, sf_dir: warc.archive_pages(_table(spark, sf_dir, "pages")),
    "op7_exact_dedup": _documents(exact.exact_dedup),
    "op8_media_sniffing": _documents(media.media_features),
    "op9_brown_scoring": _documents(brown.class_scores),
    "op10_minhash_near_dedup": _documents(minhash.near_duplicates),
    "op11_source_divergence": _documents(divergence.source_divergence),
    "op12_pii": _documents(pii.personal_data),
}

#: DuckDB SQL for those queries that SQL can express in full.
SQL = {
    "op2_temperature_mixing": mixing.SQL,
    "op6_warc": warc.SQL,
    "op11_source_divergence": divergence.SQL,
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
}
