"""Registered queries over the embeddings table, and the SQL they are checked against.

Searches take as queries every row whose id is divisible by 20, against all rows. Queries that depend on a classifier use
weights that SQL can compute too; ``trained_index_search`` trains its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, Metric
from ..functions import vectors as V
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import model as M
from ..operators import partition as P
from ..operators.knn import exact_knn
from ..operators.rerank import padded, rerank, rerank_expression
from ..sources.tables import load_vectors
from .index import PartitionIndex
from .oracles import BUCKETS, DIMS, HASHED, HIDDEN, K, MF, ORACLES, R, TOP, TOPM

__all__ = ["ORACLES", "QUERIES"]

CONFIG = IndexConfig("embeddings", 0, K, BUCKETS, R, HIDDEN)
BY_HASH = IndexConfig("embeddings", 0, 1, HASHED, R, HIDDEN)
QUERIES: dict = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_vectors(spark, f"{sf_dir}/embeddings.parquet", dims=DIMS)


def scaled(vectors: DataFrame) -> DataFrame:
    """Lengths that differ, so that the metrics rank differently."""
    return vectors.withColumn("vec", F.transform("vec", lambda x: (x.cast("double") * (1 + F.col("item") % 5)).cast("float")))


def asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("item") % 20 == 0)


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def models() -> list[M.Weights]:
    return [M.formula_weights(r, DIMS, HIDDEN, BUCKETS) for r in range(R)]


def hashed(vectors: DataFrame) -> DataFrame:
    return P.hash_partition(vectors, R, HASHED)


def own_bucket(vectors: DataFrame, repetitions: int = R) -> DataFrame:
    """Probes of queries that are items: the bucket each is in."""
    return P.hash_partition(asked(vectors), repetitions, HASHED).select(F.col("item").alias("qid"), "r", F.lit(0).alias("k"), "bucket")


def hash_hits(vectors: DataFrame, repetitions: int = R) -> DataFrame:
    return C.probe(own_bucket(vectors, repetitions), P.hash_partition(vectors, repetitions, HASHED))


def index(vectors: DataFrame) -> PartitionIndex:
    return PartitionIndex.build(vectors, CONFIG, Metric.COSINE, models())


def top(df: DataFrame) -> DataFrame:
    return longs(df.select("qid", "rk", "item"))


@registered
def vector_norms(spark, sf_dir):
    return scaled(embeddings(spark, sf_dir)).select(F.col("item").alias("vec_id"), F.round(V.norm("vec"), 6).alias("norm"))


@registered
def vector_normalize(spark, sf_dir):
    rows = scaled(embeddings(spark, sf_dir)).withColumn("norm", V.norm("vec"))
    rows = rows.select(F.col("item").alias("vec_id"), "norm", F.posexplode(V.doubles("vec")).alias("pos", "x"))
    return longs(rows.select("vec_id", "pos", F.round(F.col("x") / F.nullif("norm", F.lit(0.0)), 6).alias("x")))


@registered
def sample_rows(spark, sf_dir):
    return longs(M.sample_rows(embeddings(spark, sf_dir), 100, 0).withColumnRenamed("item", "vec_id"))


def knn(metric: Metric):
    def run(spark, sf_dir):
        v = scaled(embeddings(spark, sf_dir))
        return top(exact_knn(asked(v), v, TOP, metric))

    run.__name__ = f"knn_{metric.value}"
    return registered(run)


def reranked(metric: Metric):
    def run(spark, sf_dir):
        v = scaled(embeddings(spark, sf_dir))
        return top(PartitionIndex.hashed(v, BY_HASH, metric).search(asked(v), v, 1, MF, TOP))

    run.__name__ = f"rerank_{metric.value}"
    return registered(run)


for _metric in Metric:
    knn(_metric)
    reranked(_metric)


@registered
def rerank_l2_compat(spark, sf_dir):
    v = scaled(embeddings(spark, sf_dir))
    return top(rerank_expression(C.candidates(hash_hits(v), MF, R), v, asked(v), TOP, Metric.L2, plain_norm=True))


@registered
def hash_partition(spark, sf_dir):
    return longs(hashed(embeddings(spark, sf_dir)))


@registered
def bucket_histogram(spark, sf_dir):
    return longs(P.histogram(hashed(embeddings(spark, sf_dir)), R, HASHED))


@registered
def bucket_offsets(spark, sf_dir):
    return longs(P.offsets(hashed(embeddings(spark, sf_dir)), R, HASHED))


@registered
def postings(spark, sf_dir):
    return longs(P.postings(hashed(embeddings(spark, sf_dir))))


@registered
def load_balance(spark, sf_dir):
    return longs(P.load_balance(hashed(embeddings(spark, sf_dir)), R, HASHED).drop("spread"))


@registered
def label_multi_hot(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return longs(M.multi_hot(exact_knn(asked(v), v, TOP, Metric.COSINE), hashed(v)))


@registered
def mlp_top_buckets_sorted(spark, sf_dir):
    return longs(M.exploded(M.score_top(embeddings(spark, sf_dir), models(), K)))


@registered
def least_loaded_assign(spark, sf_dir):
    return longs(index(embeddings(spark, sf_dir)).assignment)


@registered
def probe_postings(spark, sf_dir):
    return longs(hash_hits(embeddings(spark, sf_dir)))


def met(mf: int, name: str, strict: bool = False):
    def run(spark, sf_dir):
        return C.candidates(hash_hits(embeddings(spark, sf_dir)), mf, R, strict).select("qid", "item")

    run.__name__ = name
    return registered(run)


met(1, "candidates_mf1", strict=True)
met(1, "candidates_mf1_all")
met(2, "candidates_mf2")
met(3, "candidates_mf3")


@registered
def candidates_single_rep(spark, sf_dir):
    return C.candidates(hash_hits(embeddings(spark, sf_dir), 1), MF, 1).select("qid", "item")


@registered
def candidates_capped(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return longs(index(v).candidates(asked(v), TOPM, MF, cap=20))


@registered
def candidates_adaptive(spark, sf_dir):
    return longs(C.adaptive(hash_hits(embeddings(spark, sf_dir)), 3))


@registered
def search_end_to_end(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return top(index(v).search(asked(v), v, TOPM, MF, TOP))


@registered
def recall_at_10(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    q = asked(v)
    return E.recall(index(v).search(q, v, TOPM, MF, TOP), exact_knn(q, v, TOP, Metric.COSINE), q, TOP).drop("recall")


@registered
def candidate_recall(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    q = asked(v)
    return E.recall(index(v).candidates(q, TOPM, MF), exact_knn(q, v, TOP, Metric.COSINE), q, TOP).drop("recall")


@registered
def avg_candidate_size(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return E.candidate_size(index(v).candidates(asked(v), TOPM, MF), asked(v)).drop("mean")


@registered
def result_array_padded(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    q = asked(v)
    return longs(padded(rerank(C.candidates(hash_hits(v), R, R), v, q, TOP, Metric.COSINE), q, TOP))


@registered
def index_roundtrip(spark, sf_dir):
    """Built, saved, loaded, and counted by bucket."""
    v = embeddings(spark, sf_dir)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{warehouse}/index-{uuid.uuid4().hex}"
    index(v).save(path)
    loaded = PartitionIndex.load(spark, path)
    return longs(loaded.assignment.groupBy("r", "bucket").agg(F.count(F.lit(1)).alias("n")))


#: Buckets of each repetition that trained_index_search probes; rows of the sample that it learns from, at most. Every row
#: is indexed and searched.
PROBED, LEARNED = 6, 20_000


def trained(vectors: DataFrame) -> PartitionIndex:
    config = IndexConfig("embeddings", 200, BUCKETS, BUCKETS, 2 * R, 64)
    return PartitionIndex.learn(vectors, config, Metric.COSINE, sample=LEARNED, neighbours=10, batch=100)


@registered
def trained_index_search(spark, sf_dir):
    """Few neighbours and all choices: with fewer choices the partition of so small a set collapses. Long training, twice
    the repetitions and six probes in each, for a recall of 0.9."""
    v = embeddings(spark, sf_dir)
    return top(trained(v).search(asked(v), v, PROBED, MF, TOP))
