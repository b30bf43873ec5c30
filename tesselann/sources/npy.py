"""A Spark data source for matrices in ``.npy`` files or raw row-major files, read by ranges of rows, and written.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("path", ...).load()
    spark.read.format("npy").option("path", ...).option("rows", n).option("dims", d).option("dtype", "float32").load()

    df.orderBy("item").write.format("npy").mode("append").option("path", folder).save()

Written, each partition is a file of the folder, in order, ``dtype`` float32 unless another is given; the items' ids are
beside them. A folder is read as the rows of its files in order, with the ids beside them.

The path must be one that executors can open as a file, such as a shared mount; vectors in an object store belong in
Parquet.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.arrays import matrix

BATCH = 4096


class Rows(InputPartition):
    def __init__(self, path: str, items: str | None, start: int, stop: int):
        self.path, self.items, self.start, self.stop = path, items, start, stop


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shape, self.dtype = options["path"], None, None
        if "rows" in options:
            self.shape, self.dtype = (int(options["rows"]), int(options["dims"])), options.get("dtype", "float32")
        self.parts = int(options.get("partitions", 8))

    def open(self, path: str) -> np.ndarray:
        if self.shape is None:
            return np.load(path, mmap_mode="r")
        return np.memmap(path, dtype=self.dtype, mode="r", shape=self.shape)

    def partitions(self) -> list[Rows]:
        if os.path.isdir(self.path):
            files = [(f"{self.path}/{f}", f"{self.path}/{f[:-4]}.items") for f in sorted(os.listdir(self.path)) if f.endswith(".npy")]
        else:
            files = [(self.path, None)]
        out = []
        for path, items in files:
            n = len(self.open(path))
            step = max(1, -(-n // self.parts))
            out += [Rows(path, items, at, min(n, at + step)) for at in range(0, n, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        data = self.open(partition.path)
        ids = np.fromfile(partition.items, "<i8") if partition.items else None
        for at in range(partition.start, partition.stop, BATCH):
            x = np.asarray(data[at : min(partition.stop, at + BATCH)], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x)) if ids is None else ids[at : at + len(x)]), lists], ["item", "vec"])


class NpyWriter(DataSourceArrowWriter):
    """A file a task, named by its partition and put in place when it is whole, so that a repeated task leaves one."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], options.get("dtype", "float32")
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        name = f"{self.path}/part-{task.partitionId():06d}"
        own = f"{name}-{task.taskAttemptId()}"
        rows = dims = 0
        with open(f"{own}.raw", "wb") as data, open(f"{own}.ids", "wb") as ids:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("vec"), self.dtype)
                    x.tofile(data)
                    b.column("item").to_numpy().astype("<i8").tofile(ids)
                    rows, dims = rows + len(x), x.shape[1]
        if rows:
            out = np.lib.format.open_memmap(f"{own}.tmp", "w+", np.dtype(self.dtype), (rows, dims))
            out[:] = np.memmap(f"{own}.raw", self.dtype, "r", shape=(rows, dims))
            out.flush()
            os.replace(f"{own}.ids", f"{name}.items")
            os.replace(f"{own}.tmp", f"{name}.npy")
        else:
            os.remove(f"{own}.ids")
        os.remove(f"{own}.raw")
        return WriterCommitMessage()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "item bigint, vec array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options))
