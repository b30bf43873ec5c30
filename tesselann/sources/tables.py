"""Vector, query and truth tables, and tables that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators.arrays import vectors_of
from ..operators.model import sample_rows


def load_vectors(spark: SparkSession, path: str, item: str = "vec_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """``(item, vec)`` from Parquet; only these two columns are read."""
    return vectors_of(spark.read.parquet(path), item, vector, dims)


def with_norms(vectors: DataFrame) -> DataFrame:
    """The unsquared norm beside each vector, to be kept with it."""
    return vectors.withColumn("norm", norm("vec"))


def load_queries(spark: SparkSession, path: str, item: str = "qid", vector: str = "vec", first: int | None = None) -> DataFrame:
    rows = vectors_of(spark.read.parquet(path), item, vector)
    return rows if first is None else rows.orderBy("item").limit(first)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, rk, item)`` from ``(qid, nn_ids)``."""
    return spark.read.parquet(path).select("qid", F.posexplode("nn_ids").alias("pos", "item")).select("qid", (F.col("pos") + 1).alias("rk"), "item")


def training_sample(vectors: DataFrame, n: int = 1_000_000, seed: int = 0) -> DataFrame:
    return sample_rows(vectors, n, seed)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first unless it is there in full."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(spark: SparkSession, path: str, run: str, **values: float) -> None:
    spark.createDataFrame([(run, k, float(v)) for k, v in values.items()], "run string, metric string, value double").coalesce(1).write.mode("append").parquet(path)
