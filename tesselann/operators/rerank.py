"""Candidates ranked by their exact score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Metric
from ..functions.vectors import score
from . import knn
from .arrays import collected, matrix
from .knn import ranked


def rerank_expression(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: Metric, plain_norm: bool = False) -> DataFrame:
    """``(qid, rk, item, score)`` by Column expressions alone; the form SQL has too."""
    q = queries.select(F.col("item").alias("qid"), F.col("vec").alias("qvec"))
    rows = candidates.select("qid", "item").join(vectors, "item").join(q, "qid")
    return ranked(rows.select("qid", "item", score("qvec", "vec", metric, plain_norm).alias("score")), k)


def scored(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch, metric: Metric) -> Iterator[pa.RecordBatch]:
    """The scores of a batch ``(item, vec, qids[, norm])`` against the queries ``ids``, ``q``; so many rows at once that
    ``PAIRS`` pairs are held, or one row with all of its queries."""
    ends = np.cumsum(b.column("qids").value_lengths().to_numpy())
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + knn.PAIRS, "right")))
        yield pairs_scored(ids, q, b.slice(lo, hi - lo), metric)
        lo = hi


def pairs_scored(ids: np.ndarray, q: np.ndarray, b: pa.RecordBatch, metric: Metric) -> pa.RecordBatch:
    x, want = matrix(b.column("vec")), b.column("qids")
    row = np.repeat(np.arange(b.num_rows), want.value_lengths().to_numpy())
    qid = want.flatten().to_numpy()
    at = np.searchsorted(ids, qid)
    ip = np.einsum("ij,ij->i", q[at], x[row])
    if metric is not Metric.IP:
        square = b.column("norm").to_numpy() ** 2 if "norm" in b.schema.names else (x * x).sum(1)
        if metric is Metric.L2:
            ip = 2 * ip - square[row]
        else:
            length = np.sqrt((q * q).sum(1)[at] * square[row])
            ip = np.divide(ip, length, out=np.full_like(ip, np.nan), where=length > 0)
    return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(b.column("item").to_numpy()[row]), pa.array(ip, from_pandas=True)], ["qid", "item", "score"])


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """The same for many candidates. Each item's vector is read once, and shipped once to each block of queries that wants
    it. Up to ``knn.QUERIES`` queries are broadcast; more are dealt into blocks of that size, whose matrix precedes their
    items in every task that scores for them. Vectors may carry their unsquared ``norm``."""
    spark, extra = queries.sparkSession, [c for c in ("norm",) if c in vectors.columns]
    blocks = max(1, -(-queries.count() // knn.QUERIES))
    schema = "qid long, item long, score double"
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    # at most a block's queries in a list
    wanted = candidates.select("qid", "item").join(queries.select(F.col("item").alias("qid")), "qid", "left_semi")
    wanted = wanted.groupBy("item", block("qid").alias("block")).agg(F.collect_set("qid").alias("qids"))
    rows = wanted.join(vectors.select("item", "vec", *extra), "item")
    if blocks == 1:
        told = spark.sparkContext.broadcast(collected(queries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from scored(*told.value, b, metric)

        return ranked(rows.select("item", "vec", "qids", *extra).mapInArrow(run, schema), k)
    # as many parts a block as give every shuffle partition one
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // blocks)
    items = rows.select("block", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("late"), "item", "vec", "qids", *extra)
    asked = queries.select(block("item").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("late"), "item", "vec", F.lit(None).cast("array<bigint>").alias("qids"), *(F.lit(None).cast("double").alias(c) for c in extra))
    both = asked.unionByName(items).repartition("block", "part").sortWithinPartitions("block", "part", "late", "item")

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, q = None, [], []
        for whole in batches:
            key = np.stack([whole.column(c).to_numpy() for c in ("block", "part", "late")])
            cuts = [0, *(np.nonzero((np.diff(key) != 0).any(0))[0] + 1), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                b = whole.slice(lo, hi - lo)
                if now != (own := (key[0, lo], key[1, lo])):
                    now, ids, q = own, [], []
                if key[2, lo] == 0:
                    ids, q = [*ids, b.column("item").to_numpy()], [*q, matrix(b.column("vec"))]
                    continue
                if len(ids) > 1:
                    ids, q = [np.concatenate(ids)], [np.concatenate(q)]
                yield from scored(ids[0], q[0], b, metric)

    return ranked(both.mapInArrow(blockwise, schema), k)


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, pos, item)``: exactly ``k`` rows a query, -1 where it has fewer results."""
    places = queries.select(F.col("item").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pos"))
    found = results.select("qid", (F.col("rk") - 1).alias("pos"), "item")
    return places.join(found, ["qid", "pos"], "left").select("qid", "pos", F.coalesce("item", F.lit(-1)).alias("item"))
