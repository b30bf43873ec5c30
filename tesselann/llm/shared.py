"""What the operators of this subpackage share: tables cut from their lineage, Arrow limits, column checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts otherwise fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without that setting, a temporary one, removed at the end."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not told:
        told = tempfile.mkdtemp(prefix="tesselann-")
        atexit.register(shutil.rmtree, told, True)
    sc.setCheckpointDir(told)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """``kept`` in at most two files for each core; for tables out of a shuffle, whose partitions one task then takes one
    after the other, none of them larger than before."""
    return kept(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism))


def arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, from here on: plans are lazy, and read the setting when they run. A smaller
    bound that is set already stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names`` of ``df``; names are matched exactly, so that a column such as ``Text`` beside ``text`` does no harm."""
    at = {c: i for i, c in enumerate(df.columns)}
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"no such columns: {missing}")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*(c if c in names else f"__{i}" for i, c in enumerate(df.columns)))
    return df.select(*(F.col(f"`{n}`") for n in names))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1, ..., beside which others can be put whatever ``df`` has."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
