"""Learning the partitions: train a classifier to predict the buckets of an item's neighbours, put each item in the least
loaded of its predicted buckets, and repeat."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.hashing import murmur3
from .model import LAYERS, SCHEMA, Weights
from .partition import least_loaded

RATE, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-8


def initial(dims: int, hidden: int, buckets: int, seed: int) -> Weights:
    """Normal weights of deviation 0.05, redrawn beyond two deviations."""
    rng = np.random.default_rng(seed)

    def drawn(*shape: int) -> np.ndarray:
        x = rng.normal(0, 1, shape)
        while (far := np.abs(x) > 2).any():
            x[far] = rng.normal(0, 1, far.sum())
        return (0.05 * x).astype(np.float32)

    return Weights(drawn(dims, hidden), drawn(hidden), drawn(hidden, buckets), drawn(buckets))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean sigmoid cross-entropy."""
    return float((np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))).mean())


class Trainer:
    """One repetition's classifier and its Adam moments; ``state`` has these and the number of steps by name, if it goes on
    from an earlier end."""

    def __init__(self, weights: Weights, rate: float = RATE, state: dict[str, np.ndarray] | None = None):
        self.w, self.rate = weights, rate
        zero = {f"{k}.{n}": np.zeros_like(getattr(weights, n)) for k in "mv" for n in LAYERS}
        self.moments = zero | {n: a for n, a in (state or {}).items() if n in zero}
        self.t = int((state or {}).get("t", [0])[0])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        w = self.w
        pre = x @ w.w1 + w.b1
        h = np.maximum(pre, 0)
        logits = h @ w.w2 + w.b2
        d = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) / y.size
        back = (d @ w.w2.T) * (pre > 0)
        return {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ d, "b2": d.sum(0)}, loss(logits, y)

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        grads, mean = self.gradients(x, y)
        self.t += 1
        rate = self.rate * np.sqrt(1 - BETA2**self.t) / (1 - BETA1**self.t)
        for n, g in grads.items():
            m, v = f"m.{n}", f"v.{n}"
            self.moments[m] = (BETA1 * self.moments[m] + (1 - BETA1) * g).astype(np.float32)
            self.moments[v] = (BETA2 * self.moments[v] + (1 - BETA2) * g * g).astype(np.float32)
            setattr(self.w, n, (getattr(self.w, n) - rate * self.moments[m] / (np.sqrt(self.moments[v]) + EPSILON)).astype(np.float32))
        return mean

    def state(self) -> dict[str, np.ndarray]:
        """All that a later start needs, beside the assignment."""
        return {n: getattr(self.w, n).copy() for n in LAYERS} | {n: a.copy() for n, a in self.moments.items()} | {"t": np.array([self.t], np.float32)}


def rounds(config: IndexConfig, r: int, ids: np.ndarray, x: np.ndarray, neighbours: np.ndarray, batch: int, state: dict[str, np.ndarray] | None = None, start: int = 0) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray, float]]:
    """After each round: epoch, the trainer's state, the bucket of each sample row, and the mean loss of its last epoch.
    ``neighbours`` are positions in the sample. A round starts from the assignment that the one before it ended with.
    ``state``, with the assignment as ``bucket``, and ``start`` continue an earlier run: an epoch's order depends on its
    number alone, so that a continued run equals an unbroken one."""
    b = config.buckets
    if state is None:
        signed = lambda h: h - (1 << 32) if h >> 31 else h
        bucket = np.array([signed(murmur3(int(i), r)) % b for i in ids], np.int64)
        trainer = Trainer(initial(x.shape[1], config.hidden, b, 1_000_003 + r))
    else:
        bucket = state["bucket"].astype(np.int64)
        trainer = Trainer(Weights(*(state[n].copy() for n in LAYERS)), state=state)
    for epoch in range(start + 1, config.epochs + 1):
        order, losses = np.random.default_rng((r, epoch)).permutation(len(x)), []
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            y = np.zeros((len(own), b), np.float32)
            y[np.repeat(np.arange(len(own)), neighbours.shape[1]), bucket[neighbours[own]].ravel()] = 1
            losses.append(trainer.step(x[own], y))
        if epoch % config.every == 0:
            loads = np.zeros(b, np.int64)
            new = np.empty(len(x), np.int64)
            for at in range(0, len(x), batch):
                new[at : at + batch] = least_loaded(trainer.w.top(x[at : at + batch], config.choices), loads)
            bucket = new
            yield epoch, trainer.state(), bucket, float(np.mean(losses))


#: A row of training: a layer, a moment, or ``bucket`` with the sample's assignment, at the end of a round.
ROWS = SCHEMA + ", loss double, seconds double"


def train(spark: SparkSession, config: IndexConfig, ids: np.ndarray, x: np.ndarray, neighbours: np.ndarray, batch: int = 5000, resume: tuple[int, list[dict[str, np.ndarray]]] | None = None) -> DataFrame:
    """Rows by ``ROWS`` for the end of every round. Repetitions train side by side, a task each, on the broadcast sample.
    ``resume`` has the epoch and each repetition's state of an earlier end (``ended``)."""
    told = spark.sparkContext.broadcast((ids, x.astype(np.float32), neighbours, resume))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, neighbours, resume = told.value
        for b in batches:
            for r in b.column(0).to_pylist():
                start, state = (resume[0], resume[1][r]) if resume else (0, None)
                began = time.monotonic()
                for epoch, found, own, mean in rounds(config, r, ids, x, neighbours, batch, state, start):
                    for layer, a in (found | {"bucket": own}).items():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r], pa.int32()), pa.array([epoch], pa.int32()), pa.array([layer]), pa.array([list(a.shape)], pa.list_(pa.int32())), pa.array([a.astype(np.float32).ravel()], pa.list_(pa.float32())), pa.array([mean]), pa.array([time.monotonic() - began])],
                            ["r", "epoch", "layer", "shape", "data", "loss", "seconds"],
                        )

    return spark.range(0, config.repetitions, numPartitions=config.repetitions).mapInArrow(run, ROWS)


def ended(rows: DataFrame, epoch: int | None = None) -> tuple[int, list[dict[str, np.ndarray]]]:
    """The epoch, the last by default, and each repetition's state at its end; the size of one model and its moments."""
    if epoch is None:
        epoch = rows.agg(F.max("epoch")).first()[0]
    held: dict[int, dict] = {}
    for x in rows.where(F.col("epoch") == epoch).collect() if epoch is not None else ():
        held.setdefault(x.r, {})[x.layer] = np.array(x.data, np.float32).reshape(x.shape)
    if not held:
        raise ValueError(f"nothing was trained up to epoch {epoch}")
    return epoch, [held[r] for r in sorted(held)]


def assignments(rows: DataFrame, ids: np.ndarray) -> DataFrame:
    """``(r, epoch, item, bucket)`` of the sample, from rows of ``train``."""
    own = rows.where(F.col("layer") == "bucket").select("r", "epoch", F.posexplode("data").alias("pos", "bucket"))
    items = rows.sparkSession.createDataFrame(pa.table({"pos": pa.array(np.arange(len(ids)), pa.int32()), "item": pa.array(ids, pa.int64())}))
    return own.join(items, "pos").select("r", "epoch", "item", F.col("bucket").cast("int").alias("bucket"))


def training_log(rows: DataFrame) -> DataFrame:
    """``(r, epoch, loss, seconds)``: the mean loss of the last epoch of each round, and the seconds up to its end."""
    return rows.where(F.col("layer") == "bucket").select("r", "epoch", "loss", "seconds")
