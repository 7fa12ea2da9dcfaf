"""Retrieval quality: precision, recall and reciprocal rank of ranked results against relevant ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(task, precision, recall, rr) for ranked (task, rank, item) and relevant (task, item).

    Precision divides by the results there are, at most k; a task without results or
    without relevant items scores 0.
    """
    gold = relevant.select("task", "item").distinct()
    hit = ranked.join(gold.withColumn("hit", F.lit(1)), ["task", "item"], "left")
    per_task = hit.groupBy("task").agg(
        F.count_if(F.col("rank") <= k).alias("shown"),
        F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias("hits"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
    )
    wanted = gold.groupBy("task").agg(F.count("*").alias("wanted"))
    both = wanted.join(per_task, "task", "full_outer")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return both.select("task", share("hits", "shown").alias("precision"), share("hits", "wanted").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_quality(per_task: DataFrame) -> DataFrame:
    return per_task.agg(F.count("*").alias("tasks"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))
