"""A filter of 64-bit hashes, made by the tables that hold them and passed to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a hash, places of a hash, and the most bits that a filter has. About one in 8,000 others passes; beyond some 2.8
#: million hashes more do. What passes is always joined with the hashes themselves.
BITS, PROBES, MOST_BITS = 24, 6, 1 << 26


def bloom(hashes: DataFrame) -> bytes:
    """The filter of ``hashes (t)``; the driver gets one number for each 64 bits of it, at most."""
    many = max(1, hashes.count())
    size = min(MOST_BITS, max(1 << 12, 1 << (BITS * many - 1).bit_length()))
    step = f"(pmod(shiftright(t, 27), {size}L) | 1L)"
    slots = hashes.select(F.explode(F.expr(f"transform(sequence(0, {PROBES - 1}), i -> pmod(pmod(t, {size}L) + i * {step}, {size}L))")).alias("slot"))
    words = slots.select(F.expr("slot div 64").alias("w"), F.expr("shiftleft(1L, int(pmod(slot, 64)))").alias("m"))
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return bits.astype("<i8").tobytes()


def within(t: int, own: bytes) -> bool:
    """Whether the filter lets ``t`` through."""
    last = 8 * len(own) - 1
    at, step = t & last, (t >> 27 & last) | 1
    for _ in range(PROBES):
        if not own[at >> 3] >> (at & 7) & 1:
            return False
        at = (at + step) & last
    return True


def all_within(t: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The same for many; ``own`` as an array of bytes."""
    last = 8 * len(own) - 1
    at, step, out = t & last, (t >> 27 & last) | 1, np.ones(len(t), bool)
    for _ in range(PROBES):
        out &= (own[at >> 3] >> (at & 7) & 1).astype(bool)
        at = (at + step) & last
    return out
