"""The jobs as registered queries: each runs its function twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources.cache import shared_dir

from . import passage_search, topk_growth


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_topk_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vectors whose id 10 divides; library: all others."""
    out, vectors = new_folder(spark, "job1"), f"{sf_dir}/embeddings.parquet"
    for _ in range(2):
        rows = topk_growth.run(spark, vectors, vectors, out, k=10, query_filter="vec_id % 10 = 0", library_filter="vec_id % 10 <> 0")
    return rows.selectExpr("query_index", "rank", "library_index", "round(similarity, 6) AS similarity")


def job2_passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        rows = passage_search.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return rows


QUERIES = {"job1_topk_growth": job1_topk_growth, "job2_passage_search": job2_passage_search}

SQL = {
    "job1_topk_growth": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM e),
s AS (SELECT q.vec_id AS query_index, l.vec_id AS library_index, round(list_dot_product(q.v, l.v), 12) AS s FROM n q JOIN n l ON q.vec_id % 10 = 0 AND l.vec_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY s DESC, library_index) AS rank FROM s)
SELECT query_index, rank, library_index, round(s, 6) AS similarity FROM r WHERE rank <= 10
""",
    "job2_passage_search": r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'p', item_id, text FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM t),
c AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
u AS (SELECT side, id, word, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS v FROM c),
s AS (SELECT p.id AS item_id, d.id AS doc_id, round(sum(p.v * d.v), 12) AS s FROM u p JOIN u d ON p.word = d.word AND p.side = 'p' AND d.side = 'd' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM s)
SELECT item_id, rank, doc_id, round(s, 6) AS similarity, coalesce(lang, '') AS lang FROM r JOIN documents USING (doc_id) WHERE rank <= 5 AND s >= 0.1
""",
}
