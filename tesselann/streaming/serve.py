"""Queries served as they arrive: each micro-batch is searched against the index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import PartitionIndex


def serve(stream: DataFrame, index: PartitionIndex, vectors: DataFrame, out: str, checkpoint: str, topm: int = 10, mf: int = 2, k: int = 10, once: bool = False) -> StreamingQuery:
    """Append ``(batch, qid, rk, item, score)`` to ``out`` for each query of ``stream (item, vec)``. A batch that is run
    again after a failure replaces what it wrote."""

    def answer(queries: DataFrame, batch: int) -> None:
        queries = queries.persist()
        index.search(queries, vectors, topm, mf, k).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        queries.unpersist()

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
