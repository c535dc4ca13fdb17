"""Evaluation of predicted component counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def predictions(neighbors: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """query_index, predicted_component_count, true_component_count, adaptive_k, adaptive_selected_segments."""
    one = neighbors.groupBy("query_index").agg(F.max("estimated_n_precursor_groups").alias("predicted_component_count"), F.max("adaptive_k").alias("adaptive_k"), F.max("selected_segments").alias("adaptive_selected_segments"))
    if truth is None:
        return one.withColumn("true_component_count", F.lit(None).cast("long"))
    return one.join(truth.select("query_index", F.col("component_count").alias("true_component_count")), "query_index", "left")


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: overall accuracy, and for true counts 2 and 3 accuracy, correct, total; null where there is none."""
    rows = rows.where("true_component_count is not null and predicted_component_count is not null")
    hit = (F.col("predicted_component_count") == F.col("true_component_count")).cast("long")
    parts = []
    for t in (2, 3):
        mine = F.when(F.col("true_component_count") == t, hit)
        parts += [F.avg(mine).alias(f"accuracy_true_{t}"), F.coalesce(F.sum(mine), F.lit(0)).alias(f"correct_true_{t}"), F.count(mine).alias(f"total_true_{t}")]
    return rows.agg(F.count("*").alias("n_eval"), F.avg(hit).alias("overall_accuracy"), *parts)


def combined(tables: dict[str, DataFrame]) -> DataFrame:
    """accuracy() of each method's predictions as one table, with `method` first."""
    rows = [accuracy(df).select(F.lit(name).alias("method"), "*") for name, df in sorted(tables.items())]
    if not rows:
        raise ValueError("no method")
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    return rows[0]


def long_accuracy(wide: DataFrame) -> DataFrame:
    """true_count, accuracy: for a bar chart."""
    return wide.select(F.col("accuracy_true_2").alias("2"), F.col("accuracy_true_3").alias("3")).unpivot([], ["2", "3"], "true_count", "accuracy")
