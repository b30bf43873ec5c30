"""The partitioned index: built from vectors, kept as tables, searched with DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, Metric
from ..operators import candidates as C
from ..operators import model as M
from ..operators import partition as P
from ..operators import probed
from ..operators.arrays import matrix
from ..operators.knn import exact_knn
from ..operators.rerank import rerank
from ..operators.train import ended, train
from ..sources.tables import cached, exists


def nearest(own: DataFrame, neighbours: int, metric: Metric) -> DataFrame:
    """``(item, near array<int>)``: the nearest ``neighbours`` of each row of ``own``, by their positions among its ids in
    order. The ids go to every task; they are a sample's."""
    ids = np.sort(own.select("item").toArrow().column("item").to_numpy())
    told = own.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = np.searchsorted(told.value, lists.flatten().to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32), pa.array(at))], ["item", "near"])

    found = exact_knn(own, own, neighbours, metric).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "item"))).alias("x"))
    return found.select("qid", F.col("x.item")).mapInArrow(run, "item long, near array<int>")


@dataclass
class PartitionIndex:
    """``models`` give an item's or query's buckets; ``assignment (r, item, bucket)`` is the inverted index."""

    config: IndexConfig
    metric: Metric
    models: list[M.Weights]
    assignment: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig, metric: Metric, models: list[M.Weights], block: int | None = None) -> PartitionIndex:
        """Score all ``vectors (item, vec)``, and put each item in the least loaded of its best buckets."""
        return cls(config, metric, models, P.assign_least_loaded(M.score_top(vectors, models, config.choices), config.buckets, block))

    @classmethod
    def hashed(cls, vectors: DataFrame, config: IndexConfig, metric: Metric) -> PartitionIndex:
        """An index without models: items, and queries that are items, are in the buckets of their ids' hashes."""
        return cls(config, metric, [], P.hash_partition(vectors, config.repetitions, config.buckets))

    @classmethod
    def learn(
        cls, vectors: DataFrame, config: IndexConfig, metric: Metric, sample: int = 1_000_000, neighbours: int = 100, batch: int = 5000, seed: int = 0, block: int | None = None, work: str | None = None, resume: bool = False
    ) -> PartitionIndex:
        """Train on a sample of at most ``sample`` rows and their exact nearest ``neighbours``, themselves included, then
        build over all. Small data need few neighbours and more choices, or the partition collapses: see load_balance.

        The folder ``work`` keeps the sample with its neighbours, computed once whoever asks again, and the end of every
        round; ``resume`` goes on from the last of these. The driver and every training task hold the sample in single
        precision and its neighbours' positions: with 100 dimensions and neighbours, 800 bytes a sample row."""
        spark = vectors.sparkSession

        def found() -> DataFrame:
            own = vectors.join(M.sample_rows(vectors, sample, seed).select("item"), "item", "left_semi").persist()
            return own.join(nearest(own, neighbours, metric), "item")

        rows = cached(spark, f"{work}/sample-{sample}-{neighbours}-{seed}", found) if work else found()
        t = rows.toArrow().combine_chunks()
        order = np.argsort(t.column("item").to_numpy())
        ids, x = t.column("item").to_numpy()[order], matrix(t.column("vec").combine_chunks(), np.float32)[order]
        near = matrix(t.column("near").combine_chunks(), np.int32)[order]
        del t
        path = f"{work}/training" if work else None
        last = ended(spark.read.parquet(path)) if resume and path and exists(spark, path) else None
        if last and last[0] >= config.epochs:
            return cls.build(vectors, config, metric, M.from_table(spark.read.parquet(path), config.epochs), block)
        trained = train(spark, config, ids, x, near, batch, last)
        if path:
            trained.write.mode("append" if last else "overwrite").parquet(path)
            trained = spark.read.parquet(path)
        return cls.build(vectors, config, metric, M.from_table(trained.persist(), config.epochs), block)

    def save(self, path: str) -> None:
        """Two tables: ``models``, and ``postings`` by repetition, sorted by bucket so that a probe reads few row groups."""
        spark = self.assignment.sparkSession
        M.to_table(spark, self.models, self.config.epochs).write.mode("overwrite").parquet(f"{path}/models")
        rows = self.assignment.repartitionByRange("r", "bucket").sortWithinPartitions("r", "bucket", "item")
        rows.write.mode("overwrite").partitionBy("r").parquet(f"{path}/postings")
        meta = [(self.config.name, self.config.hidden, self.config.every, self.metric.value)]
        spark.createDataFrame(meta, "name string, hidden int, every int, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PartitionIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        config = IndexConfig.parse(meta.name, hidden=meta.hidden, every=meta.every)
        rows = spark.read.parquet(f"{path}/postings").select(F.col("r").cast("int").alias("r"), "item", "bucket")
        models = spark.read.parquet(f"{path}/models")
        return cls(config, Metric(meta.metric), [] if models.isEmpty() else M.from_table(models), rows)

    def probes(self, queries: DataFrame, topm: int) -> DataFrame:
        """``(qid, r, k, bucket)``: the ``topm`` best buckets of each query in each repetition; without models, the one of
        its hash."""
        if not self.models:
            own = P.hash_partition(queries, self.config.repetitions, self.config.buckets)
            return own.select(F.col("item").alias("qid"), "r", F.lit(0).alias("k"), "bucket")
        return M.exploded(M.score_top(queries, self.models, topm)).withColumnRenamed("item", "qid")

    def hits(self, queries: DataFrame, topm: int) -> DataFrame:
        return C.probe(self.probes(queries, topm), self.assignment)

    def candidates(self, queries: DataFrame, topm: int = 10, mf: int = 2, cap: int | None = None, strict: bool = False) -> DataFrame:
        hits = self.hits(queries, topm)
        if cap is not None:
            return C.capped(hits, mf, cap, self.config.repetitions, strict)
        return C.candidates(hits, mf, self.config.repetitions, strict)

    def search(self, queries: DataFrame, vectors: DataFrame, topm: int = 10, mf: int = 2, k: int = 10, cap: int | None = None) -> DataFrame:
        """``(qid, rk, item, score)``: a plan from queries to ranked results; in one pass over the items where that costs
        less than a list of candidates, which a ``cap`` needs."""
        c = self.config
        if cap is None and probed.pays(topm if self.models else 1, c.buckets, c.repetitions):
            return probed.search(lambda q: self.probes(q, topm), self.assignment, vectors, queries, k, self.metric, mf, c.buckets, c.repetitions)
        return rerank(self.candidates(queries, topm, mf, cap), vectors, queries, k, self.metric)
