"""Exact nearest neighbours of a query set, in blocks of queries against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Metric
from .arrays import collected, matrix

#: Queries of a block: its vectors go to every task, which keeps k rows for each. Queries and vectors multiplied at once, and
#: pairs whose exact scores are made at once.
QUERIES, CHUNK, ROWS, PAIRS = 16_384, 512, 2_048, 1 << 15


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first element to the last as in SQL: equal vectors have equal ones,
    wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def exact(q: np.ndarray, x: np.ndarray, metric: Metric, q_square: np.ndarray, x_square: np.ndarray) -> np.ndarray:
    """The scores of paired rows; NaN where there is none."""
    ip = inner(q, x)
    if metric is Metric.IP:
        return ip
    if metric is Metric.L2:
        return 2 * ip - x_square
    length = np.sqrt(q_square) * np.sqrt(x_square)
    return np.divide(ip, length, out=np.full_like(ip, np.nan), where=length > 0)


def query_blocks(queries: DataFrame, size: int = QUERIES) -> Iterator[DataFrame]:
    """``queries (item, vec)`` in blocks of about ``size``."""
    many = -(-queries.count() // size)
    for k in range(many):
        yield queries if many == 1 else queries.where(F.pmod(F.xxhash64("item"), F.lit(many)) == k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """``(qid, rk, item, score)``: each query's ``k`` best, higher scores first, then lower ids; no score comes last."""
    best = W.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "item")
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select("qid", "rk", "item", "score")


def best(row: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of each row, higher scores first, then lower items."""
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], item[keep], score[keep]


def units(x: np.ndarray, square: np.ndarray) -> np.ndarray:
    length = np.sqrt(square)[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


class Best:
    """The ``k`` best items of each query, from vectors that come in chunks. A product of matrices tells which pairs may be
    among the best so far, within its rounding error; the scores of these are made exactly, and decide."""

    def __init__(self, q: np.ndarray, k: int, metric: Metric):
        self.q, self.k, self.metric, self.square = q, k, metric, inner(q, q)
        self.side = units(q, self.square) if metric is Metric.COSINE else q
        self.floor = np.full(len(q), -np.inf)
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def rough(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, items by queries, and by how much those of each query may be off."""
        of = units(x, square) if self.metric is Metric.COSINE else x
        s, ulp = of @ self.side.T, 8 * (x.shape[1] + 8) * 2.0**-53
        if self.metric is Metric.COSINE:
            s[square == 0] = -np.inf
            s[:, self.square == 0] = -np.inf
            off = np.full(len(self.q), ulp)
        else:
            most = np.sqrt(square[np.isfinite(square)].max(initial=0))
            off = ulp * np.sqrt(self.square) * most
            if self.metric is Metric.L2:
                s, off = 2 * s - square[:, None], 2 * off + ulp * most * most
        if not (np.isfinite(square).all() and np.isfinite(self.square).all()):
            s = np.where(np.isnan(s), -np.inf, s)
        return s, off

    def add(self, x: np.ndarray, items: np.ndarray, square: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``allowed``, items by queries, has the pairs that count; all do without it."""
        with np.errstate(all="ignore"):
            s, off = self.rough(x, square)
            least = lambda floor: np.where(np.isnan(floor), -np.inf, floor)
            want = s >= least(self.floor - off)
            if allowed is not None:
                want &= allowed
            if len(x) > self.k and np.count_nonzero(want) > 2 * self.k * len(self.q):
                kth = np.partition(np.where(want, s, -np.inf), len(x) - self.k, axis=0)[len(x) - self.k]
                want &= s >= least(kth - 2 * off)
            at, row = np.nonzero(want)
            if not len(at):
                return
            cuts = [slice(lo, lo + PAIRS) for lo in range(0, len(at), PAIRS)]
            score = np.concatenate([exact(self.q[row[c]], x[at[c]], self.metric, self.square[row[c]], square[at[c]]) for c in cuts])
        touched = np.zeros(len(self.q), bool)
        touched[row] = True
        own = touched[self.held[0]]
        new = best(*(np.concatenate([h[own], n]) for h, n in zip(self.held, (row, items[at], score), strict=True)), self.k)
        self.held = tuple(np.concatenate([h[~own], n]) for h, n in zip(self.held, new, strict=True))
        last = np.nonzero(np.append(np.diff(new[0]) != 0, True))[0]
        full = last[np.bincount(new[0], minlength=len(self.q))[new[0][last]] == self.k]
        self.floor[new[0][full]] = least(new[2][full])


def passed_on(ids: np.ndarray, tops: list[Best]) -> Iterator[pa.RecordBatch]:
    """``(qid, item, score)`` of the queries ``ids``, dealt to ``tops`` in chunks."""
    for at, top in zip(range(0, len(ids), CHUNK), tops, strict=True):
        row, item, score = top.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[at + row]), pa.array(item), pa.array(score, from_pandas=True)], ["qid", "item", "score"])


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, metric: Metric) -> DataFrame:
    """``(qid, rk, item, score)``, both inputs ``(item, vec)``. A query that is among the vectors finds itself.

    Each task multiplies its vectors with a block of queries and passes on its k best for each; a window then takes the
    best of all, having been cut to k in each task before the shuffle.
    """
    spark, out = queries.sparkSession, None
    for block in query_blocks(queries):
        ids, q = collected(block)
        told = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            ids, q = told.value
            tops = [Best(q[at : at + CHUNK], k, metric) for at in range(0, len(ids), CHUNK)]
            for b in batches:
                x_all, items = matrix(b.column(1)), b.column(0).to_numpy()
                for lo in range(0, len(items), ROWS):
                    x = x_all[lo : lo + ROWS]
                    square = inner(x, x)
                    for top in tops:
                        top.add(x, items[lo : lo + ROWS], square)
            yield from passed_on(ids, tops)

        part = ranked(vectors.select("item", "vec").mapInArrow(run, "qid long, item long, score double"), k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "qid long, rk int, item long, score double")
