"""``python -m tesselann.cli learn|query``: build an index from a table of vectors, or search one."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import IndexConfig, Metric
from .operators.evaluate import candidate_size, recall
from .operators.knn import exact_knn
from .operators.train import training_log
from .plans.index import PartitionIndex
from .sources.tables import append_metrics, load_queries, load_vectors


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=("learn", "query"))
    p.add_argument("--index", required=True, help="name, such as glove_epc20_K2_B4096_R4")
    p.add_argument("--vectors", required=True, help="Parquet of item and vector")
    p.add_argument("--path", required=True, help="where the index is or goes")
    p.add_argument("--item", default="vec_id")
    p.add_argument("--vector", default="embedding")
    p.add_argument("--metric", choices=[m.value for m in Metric], default="cosine")
    p.add_argument("--hidden", type=int, default=512)
    p.add_argument("--neighbours", type=int, default=100)
    p.add_argument("--sample", type=int, default=1_000_000)
    p.add_argument("--batch", type=int, default=5000)
    p.add_argument("--queries", help="Parquet of item and vector")
    p.add_argument("--out", help="where results go")
    p.add_argument("--metrics", help="where recall and candidate size are appended")
    p.add_argument("--topm", type=int, default=10)
    p.add_argument("--mf", type=int, default=2)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--first", type=int, help="only the first queries by id")
    p.add_argument("--cap", type=int, help="candidates that a query keeps, at most; 0 for the index's own bound")
    p.add_argument("--work", help="folder that keeps the sample, its neighbours and every round's end")
    p.add_argument("--resume", action="store_true", help="go on from the last round in --work")
    p.add_argument("--block", type=int, help="balance ranges of so many ids apart from each other, in parallel")
    p.add_argument("--no-rerank", action="store_true", help="return candidates")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tesselann").getOrCreate()
    vectors = load_vectors(spark, a.vectors, a.item, a.vector)
    if a.what == "learn":
        config = IndexConfig.parse(a.index, hidden=a.hidden)
        began = time.monotonic()
        PartitionIndex.learn(vectors, config, Metric(a.metric), a.sample, a.neighbours, a.batch, block=a.block, work=a.work, resume=a.resume).save(f"{a.path}/{a.index}")
        if a.metrics:
            log = training_log(spark.read.parquet(f"{a.work}/training")).groupBy("epoch").agg(F.avg("loss").alias("loss")).collect() if a.work else []
            append_metrics(spark, a.metrics, a.index, learn_seconds=time.monotonic() - began, **{f"loss_{x.epoch}": x.loss for x in log})
        return
    index = PartitionIndex.load(spark, f"{a.path}/{a.index}")
    queries = load_queries(spark, a.queries, a.item, a.vector, a.first)
    cap = a.cap if a.cap != 0 else index.config.cap(vectors.count(), a.topm, a.mf)
    found = index.candidates(queries, a.topm, a.mf, cap) if a.no_rerank else index.search(queries, vectors, a.topm, a.mf, a.k, cap)
    began = time.monotonic()
    if a.out:
        found.write.mode("overwrite").parquet(a.out)
        found = spark.read.parquet(a.out)
    seconds = time.monotonic() - began
    if a.metrics:
        truth = exact_knn(queries, vectors, a.k, index.metric)
        sizes = candidate_size(index.candidates(queries, a.topm, a.mf, cap), queries).first()
        append_metrics(spark, a.metrics, a.index, recall=recall(found, truth, queries, a.k).first().recall, candidates=sizes["mean"], **({"query_seconds": seconds} if a.out else {}))


if __name__ == "__main__":
    main()
