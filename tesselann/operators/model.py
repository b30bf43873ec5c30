"""Bucket classifiers: one multilayer perceptron for each repetition, applied to batches of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import murmur3
from .arrays import matrix

SCHEMA = "r int, epoch int, layer string, shape array<int>, data array<float>"
LAYERS = ("w1", "b1", "w2", "b2")
#: Scores held at once; a batch of rows is worked through in chunks of this size over the number of buckets.
SCORES = 1 << 22


@dataclass
class Weights:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(self.w1.dtype, copy=False)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` best buckets of each row, higher logits first, then lower buckets; chunk by chunk."""
        k, rows = min(k, self.b2.shape[0]), max(1, SCORES // self.b2.shape[0])
        return np.concatenate([np.zeros((0, k), np.int64), *(best_columns(self.logits(x[at : at + rows]), k) for at in range(0, len(x), rows))])


def best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` highest scores of each row, lower columns first among equals; only these are sorted."""
    n = s.shape[1]
    row, col = np.nonzero(s >= np.partition(s, n - k, axis=1)[:, n - k, None])
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    return col[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(s), k)


def formula_weights(r: int, dims: int, hidden: int, buckets: int) -> Weights:
    """Weights that SQL can compute too: eighths from -8/8 to 8/8 by a hash of their place. Sums of their products with
    single-precision vectors are exact in double, whatever the order."""

    def values(n: int, seed: int) -> np.ndarray:
        return np.array([(murmur3(i, seed) % 17 - 8) / 8 for i in range(n)])

    return Weights(values(dims * hidden, 1000 + r).reshape(dims, hidden), values(hidden, 3000 + r) / 64, values(hidden * buckets, 2000 + r).reshape(hidden, buckets), values(buckets, 4000 + r) / 64)


def to_rows(models: list[Weights], epoch: int) -> list[tuple]:
    return [(r, epoch, name, list(a.shape), a.astype(np.float32).ravel().tolist()) for r, m in enumerate(models) for name in LAYERS for a in [getattr(m, name)]]


def to_table(spark: SparkSession, models: list[Weights], epoch: int) -> DataFrame:
    return spark.createDataFrame(to_rows(models, epoch), SCHEMA)


def from_table(table: DataFrame, epoch: int | None = None) -> list[Weights]:
    """The models of ``epoch``, or of the last one."""
    if epoch is None:
        epoch = table.agg(F.max("epoch")).first()[0]
    rows = table.where((F.col("epoch") == epoch) & F.col("layer").isin(*LAYERS)).collect()
    if not rows:
        raise ValueError(f"no model of epoch {epoch}")
    held: dict[int, dict] = {}
    for x in rows:
        held.setdefault(x.r, {})[x.layer] = np.array(x.data, np.float32).reshape(x.shape)
    return [Weights(**held[r]) for r in sorted(held)]


def score_top(vectors: DataFrame, models: list[Weights], k: int) -> DataFrame:
    """``(r, item, choices array<int>)``: the ``k`` best buckets of each item in each repetition. The weights go to every
    task; they depend on the index's parameters, not on the number of items."""
    told = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            for r, m in enumerate(told.value):
                best = m.top(x, k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r, np.int32)), b.column(0), lists], ["r", "item", "choices"])

    return vectors.select("item", "vec").mapInArrow(run, "r int, item long, choices array<int>")


def exploded(choices: DataFrame, item: str = "item") -> DataFrame:
    """``(r, <item>, k, bucket)``, the best choice with k 0."""
    return choices.select("r", F.col("item").alias(item), F.posexplode("choices").alias("k", "bucket"))


def multi_hot(truth: DataFrame, assignment: DataFrame) -> DataFrame:
    """``(r, train_id, bucket)``: the distinct buckets of each row's true neighbours ``truth (qid, item)``."""
    return truth.select(F.col("qid").alias("train_id"), "item").join(assignment, "item").select("r", "train_id", "bucket").distinct()


def sample_rows(items: DataFrame, n: int, seed: int) -> DataFrame:
    """``(train_id, item)``: ``n`` rows without replacement, the first by a seeded hash; numbered by id from 0."""
    from ..functions.hashing import murmur3_seeded

    own = items.select("item").orderBy(murmur3_seeded(F.col("item"), seed), "item").limit(n)
    return own.select((F.row_number().over(W.orderBy("item")) - 1).alias("train_id"), "item")  # at most n rows
