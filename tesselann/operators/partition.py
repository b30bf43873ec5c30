"""Items dealt to buckets, and the inverted index that this gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket


def hash_partition(items: DataFrame, repetitions: int, buckets: int) -> DataFrame:
    """``(r, item, bucket)``: independent partitions by seeded hashes; a projection, no shuffle."""
    parts = F.array(*(F.struct(F.lit(r).alias("r"), hash_bucket(F.col("item"), r, buckets).alias("bucket")) for r in range(repetitions)))
    return items.select("item", F.explode(parts).alias("p")).select("p.r", "item", "p.bucket")


def all_buckets(spark, repetitions: int, buckets: int) -> DataFrame:
    return spark.range(repetitions * buckets).select(F.expr(f"int(id div {buckets})").alias("r"), F.expr(f"int(id % {buckets})").alias("bucket"))


def histogram(assignment: DataFrame, repetitions: int, buckets: int) -> DataFrame:
    """``(r, bucket, n)``, empty buckets too."""
    n = assignment.groupBy("r", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return all_buckets(assignment.sparkSession, repetitions, buckets).join(n, ["r", "bucket"], "left").select("r", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def offsets(assignment: DataFrame, repetitions: int, buckets: int) -> DataFrame:
    """``(r, bucket, start, stop)``: the range of each bucket in its repetition's postings."""
    up = F.sum("n").over(W.partitionBy("r").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    return histogram(assignment, repetitions, buckets).withColumn("stop", up).select("r", "bucket", (F.col("stop") - F.col("n")).alias("start"), "stop")


def postings(assignment: DataFrame) -> DataFrame:
    """``(r, bucket, pos, item)``: items ascending within a bucket."""
    at = F.row_number().over(W.partitionBy("r", "bucket").orderBy("item")) - 1
    return assignment.withColumn("pos", at).select("r", "bucket", "pos", "item")


def posting_lists(assignment: DataFrame) -> DataFrame:
    """``(r, bucket, items)``: one row a bucket; for buckets that are balanced, and so bounded."""
    return assignment.groupBy("r", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))


def load_balance(assignment: DataFrame, repetitions: int, buckets: int) -> DataFrame:
    n = histogram(assignment, repetitions, buckets)
    return n.groupBy("r").agg(F.max("n").alias("max_load"), F.min("n").alias("min_load"), F.count_if(F.col("n") > 0).alias("non_empty"), F.stddev_pop("n").alias("spread"))


def least_loaded(choices: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """Each row's item goes to the least loaded of its choices, the first of equals; ``loads`` is brought up to date."""
    out = np.empty(len(choices), np.int32)
    held = loads.tolist()
    for i, own in enumerate(choices.tolist()):
        best = min(own, key=held.__getitem__)
        held[best] += 1
        out[i] = best
    loads[:] = held
    return out


def assign_least_loaded(preferences: DataFrame, buckets: int, block: int | None = None) -> DataFrame:
    """``(r, item, bucket)`` from ``preferences (r, item, choices array<int>)``, the most preferred first.

    Exact: each repetition's items pass one after the other, by id, through one task, which holds the loads alone; sorting
    spills, and nothing else is held. ``block`` trades that order for parallelism: ids are dealt to ranges of ``block``,
    each of which balances on its own, starting from equal loads; the result then differs from the exact one.
    """
    key = ["r"] if block is None else ["r", "b"]
    rows = preferences if block is None else preferences.withColumn("b", F.expr(f"item div {int(block)}"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "item")
    names = [*key, "item", "choices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loads = None, np.zeros(buckets, np.int64)
        for b in batches:
            r = b.column("r").to_numpy()
            part = r if block is None else b.column("b").to_numpy()
            out = np.empty(b.num_rows, np.int32)
            cuts = np.nonzero((np.diff(r) != 0) | (np.diff(part) != 0))[0] + 1
            lists = b.column("choices").to_pylist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (r[lo], part[lo]) != now:
                    now, loads = (r[lo], part[lo]), np.zeros(buckets, np.int64)
                own = lists[lo:hi]
                out[lo:hi] = least_loaded(np.array(own, np.int64).reshape(hi - lo, -1), loads)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("item"), pa.array(out)], ["r", "item", "bucket"])

    return rows.select(*names).mapInArrow(run, "r int, item long, bucket int")

