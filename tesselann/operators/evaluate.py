"""Recall, candidate sizes and what they are worth together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(n_hits, n_queries, recall)`` of ``found (qid, item)`` against the first ``k`` of ``truth (qid, rk, item)``, over all
    ``queries (item)``."""
    hits = truth.where(F.col("rk") <= k).join(found.select("qid", "item").distinct(), ["qid", "item"], "left_semi")
    hits = hits.agg(F.count(F.lit(1)).alias("n_hits"))
    asked = queries.agg(F.count(F.lit(1)).alias("n_queries"))
    both = hits.withColumn("one", F.lit(1)).join(asked.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("recall", F.col("n_hits") / F.nullif(F.col("n_queries") * k, F.lit(0)))


def candidate_size(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``(total, n_queries, mean)``; queries without candidates count."""
    n = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    rows = queries.select(F.col("item").alias("qid")).join(n, "qid", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("n", F.lit(0))).alias("mean"))
