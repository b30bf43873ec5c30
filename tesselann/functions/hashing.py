"""Seeded MurmurHash3 of integers, inside the JVM.

Spark's ``hash`` is MurmurHash3 x86 32 with seed 42, and ``hash(a, b)`` takes the hash of a as the seed for b. The hash of
one 4-byte word is a bijection, so that for every seed there is an integer whose hash under 42 is that seed.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 0xFFFFFFFF
# fixed values: the constants of MurmurHash3 x86 32
C1, C2, C3, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def left(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & M


def murmur3(x: int, seed: int) -> int:
    """Unsigned MurmurHash3 of a 4-byte word."""
    h = seed & M
    h ^= left((x & M) * C1 & M, 15) * C2 & M
    h = (left(h, 13) * 5 + C3) & M
    h ^= 4
    h = (h ^ (h >> 16)) * F1 & M
    h = (h ^ (h >> 13)) * F2 & M
    return h ^ (h >> 16)


@lru_cache
def preimage(seed: int, under: int = 42) -> int:
    """The signed integer whose hash under the seed ``under`` is ``seed``: every step of the hash, undone."""
    inverse = lambda c: pow(c, -1, 1 << 32)
    h = seed & M
    h ^= h >> 16
    h = h * inverse(F2) & M
    h ^= (h >> 13) ^ (h >> 26)
    h = h * inverse(F1) & M
    h ^= h >> 16
    h ^= 4
    h = left((h - C3) * inverse(5) & M, 19) ^ (under & M)
    x = left(h * inverse(C2) & M, 17) * inverse(C1) & M
    return x - (1 << 32) if x >> 31 else x


def murmur3_seeded(item: Column, seed: int) -> Column:
    """Signed MurmurHash3 of ``item`` as a 4-byte word; null outside that range."""
    word = F.when(item.between(-(2**31), 2**31 - 1), item.cast("int"))
    return F.when(word.isNotNull(), F.hash(F.lit(preimage(seed)).cast("int"), word))


def hash_bucket(item: Column, seed: int, buckets: int) -> Column:
    """A bucket from 0; ids beyond 4 bytes are hashed by all 8."""
    return F.pmod(F.coalesce(murmur3_seeded(item, seed).cast("long"), F.xxhash64(F.lit(seed), item)), F.lit(buckets)).cast("int")
