"""Candidates of queries: items that recur in the buckets probed for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def probe(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """``(qid, r, k, item)``: the items of every bucket of ``probes (qid, r, k, bucket)``."""
    return probes.join(postings.select("r", "bucket", "item"), ["r", "bucket"]).select("qid", "r", "k", "item")


def candidates(hits: DataFrame, mf: int, repetitions: int, strict: bool = False) -> DataFrame:
    """``(qid, item, hits)``: items met in at least ``mf`` repetitions. A single repetition takes all of its items. With
    ``strict`` and mf 1, items met in the first repetition alone are left out, as they are never tested there."""
    if repetitions == 1:
        return hits.groupBy("qid", "item").agg(F.count(F.lit(1)).alias("hits"))
    out = hits.groupBy("qid", "item").agg(F.count(F.lit(1)).alias("hits"), F.max("r").alias("last"))
    out = out.where(F.col("hits") >= max(1, mf))
    if strict and mf == 1:
        out = out.where(F.col("last") > 0)
    return out.drop("last")


def capped(hits: DataFrame, mf: int, cap: int | None, repetitions: int, strict: bool = False) -> DataFrame:
    """``(qid, pos, item)``: candidates in the order in which they reach ``mf`` hits, by repetition, probe and item; at most
    ``cap`` a query."""
    rows = hits.where(F.col("r") > 0) if strict and mf == 1 and repetitions > 1 else hits
    need = 1 if repetitions == 1 else max(1, mf)
    nth = F.row_number().over(W.partitionBy("qid", "item").orderBy("r", "k"))
    reach = rows.withColumn("n", nth).where(F.col("n") == need)
    out = reach.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("r", "k", "item")) - 1)
    return (out if cap is None else out.where(F.col("pos") < cap)).select("qid", "pos", "item")


def adaptive(hits: DataFrame, mf: int, least: int = 10) -> DataFrame:
    """``(qid, threshold, item)``: the threshold is lowered from ``mf`` until ``least`` items reach it, to 1 at most."""
    n = hits.groupBy("qid", "item").agg(F.count(F.lit(1)).alias("hits"))
    by = n.groupBy("qid").agg(*(F.count_if(F.col("hits") >= t).alias(f"t{t}") for t in range(1, mf + 1)))
    level = F.coalesce(*(F.when(F.col(f"t{t}") >= least, F.lit(t)) for t in range(mf, 0, -1)), F.lit(1))
    return n.join(by.select("qid", level.alias("threshold")), "qid").where("hits >= threshold").select("qid", "threshold", "item")
