"""Near-duplicates by 64-bit SimHash, linked through vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // 2`` bits of their upper or of
their lower half. So there is one vantage-point tree for each half; its metric is the Hamming distance on that half,
and its search radius ``r = radius // 2``. A node has a centre and a median distance m. Fingerprints at distance up to
m go left, others right; by the triangle inequality only those at m+1 .. m+r can have a partner on the left, and these
go to both sides. Two linked fingerprints thus share a leaf in at least one tree. A leaf is a shard: one task splits it
further by the same rule, and compares what is left exactly, over all 64 bits.

The trees are fitted on a bounded sample of distinct fingerprints (``SAMPLE``); it decides only how even the shards
are, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow, columns, few, kept

#: Fingerprints that the trees are fitted on, at most; fingerprints a shard should hold; shards of a tree, at most.
SAMPLE, SHARD, MOST_SHARDS = 65_536, 2_000, 4_096
#: Within a shard, sets up to this size are compared directly.
DIRECT = 256
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))


def simhash(text: str | None, width: int = 3, block: int = 1 << 15) -> int:
    """The fingerprint of a text as an unsigned number; zero where it has no word.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are ``width`` words (or all, if fewer).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    many = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, many), block)


def majority(h: np.ndarray, block: int = 1 << 15) -> int:
    """The number whose bits are those set in over half of ``h``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        ones += np.unpackbits(h[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)``, a row for each row of ``docs (doc_id, text)``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x, width) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    arrow(docs.sparkSession)
    own = columns(docs, "doc_id", "text")
    return own.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def distance(x: np.ndarray, centre: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ centre) & mask)


def vantage(x: np.ndarray, mask: np.uint64, r: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The centre and distance, of a few tried, that split ``x`` best: with the least left to compare; none if
    none spares a tenth."""
    best = None
    for centre in x[:: max(1, len(x) // tries)][:tries]:
        d = distance(x[:: max(1, len(x) // 2048)], centre, mask)
        count = np.bincount(d, minlength=70).cumsum()
        for m in {int(np.median(d)), int(np.median(d)) - 1, int(np.median(d)) + 1} - {-1}:
            left, right = count[min(m + r, 69)], count[69] - count[m]
            cost = left * left + right * right
            if cost <= 0.9 * len(d) ** 2 and (best is None or cost < best[0]):
                best = (cost, centre, m)
    return best and best[1:]


def plant(x: np.ndarray, mask: np.uint64, r: int, leaf: int) -> list:
    """A tree over ``x``: nodes ``(centre, m, left, right)``; a leaf is ``None``."""
    nodes: list = []

    def grow(own: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(own) > leaf and (v := vantage(own, mask, r)):
            d = distance(own, v[0], mask)
            nodes[at] = (int(v[0]), v[1], grow(own[d <= v[1] + r]), grow(own[d > v[1]]))
        return at

    grow(x)
    return nodes


def route(x: np.ndarray, nodes: list, mask: np.uint64, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``x`` and the leaf of each; a fingerprint near a boundary has several."""
    todo, where, leaf = [(0, np.arange(len(x)))], [], []
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if nodes[at] is None:
            where.append(own)
            leaf.append(np.full(len(own), at))
            continue
        centre, m, left, right = nodes[at]
        d = distance(x[own], np.uint64(centre), mask)
        todo += [(left, own[d <= m + r]), (right, own[d > m])]
    return (np.concatenate(where), np.concatenate(leaf)) if where else (np.zeros(0, int), np.zeros(0, int))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after the links a-b; a label is the smallest position of its component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(flat := new[new], new):
            new = flat
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def links(x: np.ndarray, radius: int, mask: np.uint64, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct ``x`` under distance ``radius``, so far as ``mask`` can find them."""
    todo, found = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) > DIRECT and (v := vantage(x[own], mask, r)):
            d = distance(x[own], v[0], mask)
            todo += [own[d <= v[1] + r], own[d > v[1]]]
            continue
        # a leaf has labels of its own, so that its work doesn't grow with the shard
        label = np.arange(len(own))
        for i in range(0, len(own), DIRECT):
            rows = np.arange(i, min(len(own), i + DIRECT))
            for j in range(i, len(own), 4096):
                cols = np.arange(j, min(len(own), j + 4096))
                a, b = np.nonzero(np.bitwise_count(x[own[rows]][:, None] ^ x[own[cols]][None, :]) <= radius)
                # in the first block each row matches itself
                if len(a) > (len(rows) if j == i else 0):
                    label = joined(label, rows[a], cols[b])
        moved = np.nonzero(label != np.arange(len(own)))[0]
        found.append(np.stack([own[moved], own[label[moved]]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    label = joined(np.arange(len(x)), a, b) if len(a) else np.arange(len(x))
    moved = np.nonzero(label != np.arange(len(x)))[0]
    return x[moved], x[label[moved]]


def linked(found: DataFrame, radius: int = 3) -> DataFrame:
    """``(node, root)``: the component of each of the distinct fingerprints ``found (fp long)`` that has a link."""
    spark, r = found.sparkSession, radius // 2
    many = found.count()
    # the smallest by hash: the same sample whichever way the rows are dealt
    sample = np.array([x.fp for x in found.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    size = max(SHARD, many // MOST_SHARDS)
    leaf = max(16, size * len(sample) // max(1, many))
    trees = [plant(sample, mask, r, leaf) for mask in HALVES]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (nodes, mask) in enumerate(zip(trees, HALVES, strict=True)):
                where, shard = route(x, nodes, mask, r)
                yield pa.RecordBatch.from_arrays([pa.array(shard * 2 + t, pa.int64()), pa.array(x[where].view(np.int64))], ["shard", "fp"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        x = np.unique(group.column("fp").to_numpy().view(np.uint64))
        a, b = links(x, radius, HALVES[key[0].as_py() % 2], r)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    arrow(spark)
    shards = found.select("fp").mapInArrow(deal, "shard long, fp long")
    return components(shards.groupBy("shard").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` differing bits reach. Texts without words
    (null, empty, white space) have the fingerprint zero and link as any other. Rows that repeat a doc_id each count; a
    row without doc_id links nothing, and gets the component of its fingerprint if other rows have it, else null.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    prints = kept(fingerprints(docs, width))
    found = few(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = linked(found, radius).withColumnRenamed("node", "fp")
    whole = found.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    own = whole.join(lows, "root").select("fp", "component_id")
    return prints.join(own, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
