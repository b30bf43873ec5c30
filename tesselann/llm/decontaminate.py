"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact verification.

A window of as many words as an item is a match if at least ``SIMILAR`` of the item's shingles, each weighed by how often
it occurs, are in the window. Fingerprints are over words and word pairs. Windows are fingerprinted if enough of their
shingles are shingles of any items of that many words, which no match can lack. Two fingerprints within ``RADIUS`` bits
differ in at most three bits of one of eight blocks of eight, so that looking up each block's value and all values within
three bits of it finds every item within the radius; these are verified exactly.

A window that holds just 0.8 of an item, in one run, differs from it in 13 bits of 64 on average, with a deviation of 3.2:
one in about 100,000 lies beyond the radius.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batches, mixed, shingles, word_hashes
from .shared import arrow, columns, numbered
from .subword import ODD

WIDTH, SIMILAR, RADIUS = 5, 0.8, 27
#: Items that one pass over the documents looks for; more take more passes.
ITEMS = 20_000
#: Blocks of a fingerprint; what a block's value may be changed by, at most RADIUS // BLOCKS bits.
BLOCKS = 8
FLIPS = np.array([x for x in range(256) if x.bit_count() <= RADIUS // BLOCKS])
FILTER = 1 << 22
#: Windows that are looked up at once.
WINDOWS = 1 << 10


def signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def window_prints(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words of ``h`` that begin at ``at``: over words and pairs of neighbours."""
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(h), axis=0)])
    pairs = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(mixed(h[:-1] * ODD + h[1:])), axis=0)])
    votes = total[at + size] - total[at] + pairs[np.minimum(at + size - 1, len(pairs) - 1)] - pairs[at]
    return np.packbits(votes > 0, axis=1).view(">u8").astype(np.uint64).ravel()


@dataclass
class Size:
    """The items of one number of words: fingerprints, shingle counts, and for each block the items by its value."""

    width: int
    items: list[int]
    prints: np.ndarray
    counts: list[Counter]
    starts: list[np.ndarray]
    order: list[np.ndarray]
    #: places of the items' shingles among all keys; where the items of each begin in ``owner``
    known: np.ndarray | None = None
    first: np.ndarray | None = None
    owner: np.ndarray | None = None


def blocks(prints: np.ndarray) -> np.ndarray:
    return prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)


class Index:
    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH):
        own: dict[bytes, tuple[int, np.ndarray]] = {}
        for item, text in sorted(items):
            h = word_hashes(text or "")
            if len(h):
                own.setdefault(h.tobytes(), (item, h))
        self.sizes: dict[int, Size] = {}
        by: dict[int, list] = {}
        for item, h in own.values():
            by.setdefault(len(h), []).append((item, h))
        keys: dict[int, list] = {}
        for size, found in sorted(by.items()):
            w = min(width, size)
            all_ = [shingles(h, w) for _, h in found]
            keys.setdefault(w, []).extend(all_)
            prints = np.concatenate([window_prints(h, np.array([0]), size) for _, h in found])
            parts = blocks(prints)
            starts = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, b], minlength=256))]) for b in range(BLOCKS)]
            order = [np.argsort(parts[:, b], kind="stable") for b in range(BLOCKS)]
            self.sizes[size] = Size(w, [i for i, _ in found], prints, [Counter(s.tolist()) for s in all_], starts, order)
        self.keys = {w: np.unique(np.concatenate(k)) for w, k in keys.items()}
        # for each key the numbers of words of the items that have it
        self.sized = {}
        for w, known in self.keys.items():
            pairs = [np.stack([np.searchsorted(known, np.array(list(c), np.uint64)), np.full(len(c), n)]) for n, z in self.sizes.items() if z.width == w for c in z.counts]
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            self.sized[w] = (np.searchsorted(pairs[0], np.arange(len(known) + 1)), pairs[1])
        for z in self.sizes.values():
            keys = self.keys[z.width]
            pairs = np.concatenate([np.stack([np.searchsorted(keys, np.array(list(c), np.uint64)), np.full(len(c), i)]) for i, c in enumerate(z.counts)], axis=1)
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            z.known, at = np.unique(pairs[0], return_index=True)
            z.first, z.owner = np.append(at, pairs.shape[1]), pairs[1]
        self.filters = {}
        for w, k in self.keys.items():
            self.filters[w] = np.zeros(FILTER, bool)
            self.filters[w][(k % np.uint64(FILTER)).astype(np.int64)] = True
        self.longest = max(self.sizes, default=0)

    def hits(self, h: np.ndarray, which: np.ndarray, width: int) -> np.ndarray:
        """Which key the shingle that begins at each word is; -1 for none."""
        s = shingles(h, width)
        out = np.full(len(h), -1)
        if len(s):
            at = np.nonzero(self.filters[width][(s % np.uint64(FILTER)).astype(np.int64)])[0]
            at = at[which[at] == which[at + width - 1]]
            keys = self.keys[width]
            place = np.minimum(np.searchsorted(keys, s[at]), len(keys) - 1)
            own = keys[place] == s[at]
            out[at[own]] = place[own]
        return out

    def near(self, prints: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) of fingerprints within the radius."""
        parts, pairs = blocks(prints), []
        for b in range(BLOCKS):
            probe = parts[:, b].astype(np.int64)[:, None] ^ FLIPS[None, :]
            lo, n = size.starts[b][probe].ravel(), (size.starts[b][probe + 1] - size.starts[b][probe]).ravel()
            window = np.repeat(np.repeat(np.arange(len(prints)), len(FLIPS)), n)
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            pairs.append(window * len(size.items) + size.order[b][slot])
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // len(size.items), pairs % len(size.items)
        close = np.bitwise_count(prints[window] ^ size.prints[item]) <= RADIUS
        return window[close], item[close]

    def within(self, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Which items of ``n`` words have a fingerprint within the radius of that of a window that begins ``at``."""
        size, out = self.sizes[n], np.zeros(len(self.sizes[n].items), bool)
        for lo in range(0, len(at), WINDOWS):
            own = at[lo : lo + WINDOWS]
            for part in np.split(own, np.nonzero(np.diff(own) > n)[0] + 1):  # what lies between far windows is not read
                out[self.near(np.unique(window_prints(h[part[0] : part[-1] + n], part - part[0], n)), size)[1]] = True
        return out

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, int]]]:
        """For each text the items that it holds, with the highest similarity and the first word where that is."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for which, number, h in batches(texts, self.longest):
            found = {w: self.hits(h, which, w) for w in self.keys}
            for k in np.unique(which[np.max(list(found.values()), axis=0) >= 0]) if found else ():
                lo, hi = np.searchsorted(which, [k, k + 1])
                self._text(h[lo:hi], {w: f[lo:hi] for w, f in found.items()}, int(number[lo]), out[k])
        return out

    def _text(self, h: np.ndarray, found: dict[int, np.ndarray], base: int, out: dict) -> None:
        where: dict[int, list[np.ndarray]] = {}
        for w, f in found.items():
            at = np.nonzero(f >= 0)[0]
            starts, sizes = self.sized[w]
            many = starts[f[at] + 1] - starts[f[at]]
            own = np.repeat(starts[f[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            for n in np.unique(sizes[own]):
                where[int(n)] = np.repeat(at, many)[sizes[own] == n]
        for n, hits in where.items():
            size = self.sizes[n]
            many = n - size.width + 1
            if n > len(h) or len(hits) < SIMILAR * many - 1e-9:
                continue
            # windows of `many` shingle places: those that hold enough hits begin at most `many` - 1 before one
            total = np.concatenate([[0], np.cumsum(np.bincount(hits, minlength=len(h) - size.width + 1))])
            at = np.nonzero(total[many:] - total[:-many] >= SIMILAR * many - 1e-9)[0]
            if not len(at):
                continue
            near = self.within(h, at, n)
            # the hits within those windows, by the items that have the shingle
            edge = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + many, minlength=len(h) + 1)[: len(h) + 1]
            hits = hits[np.cumsum(edge)[hits] > 0]
            slot = np.searchsorted(size.known, found[size.width][hits])
            lo, times = size.first[slot], size.first[slot + 1] - size.first[slot]
            item = size.owner[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - lo, times)]
            place = np.repeat(hits, times)
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            for i in np.nonzero(near & (np.bincount(item, minlength=len(size.items)) >= SIMILAR * many - 1e-9))[0]:
                own = place[np.searchsorted(item, i) : np.searchsorted(item, i, "right")]
                # the hits that begin a window with enough of them, `least` hits in `many` places
                least = max(1, int(np.ceil(SIMILAR * many - 1e-9)))
                if not (own[least - 1 :] - own[: len(own) - least + 1] < many).any():
                    continue
                same, x = best(own, found[size.width], size.counts[i], self.keys[size.width], many, len(h) - n)
                if same / many >= SIMILAR - 1e-9 and same / many > out.get(size.items[i], (0.0,))[0]:
                    out[size.items[i]] = (same / many, base + x)


def best(own: np.ndarray, found: np.ndarray, counts: Counter, keys: np.ndarray, many: int, last: int) -> tuple[int, int]:
    """The most of an item's shingles that a window of ``many`` places has, and the first window that has so many. ``own``
    are the places of the item's shingles; a window begins at 0 to ``last``. The count rises only where a window comes to
    end at a hit, so that only those windows are looked at."""
    have: Counter = Counter()
    same = gone = 0
    top = (0, 0)
    for at in own.tolist():
        x = max(0, at - many + 1)
        while own[gone] < x:
            k = int(keys[found[own[gone]]])
            have[k] -= 1
            same -= have[k] < counts[k]
            gone += 1
        k = int(keys[found[at]])
        same += have[k] < counts[k]
        have[k] += 1
        if same > top[0] and x <= last:
            top = (same, x)
    return top


def passes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, ``ITEMS`` in each or about; items with the same text are dealt together."""
    own = columns(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    own = own.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    many = -(-own.count() // ITEMS)
    for k in range(many):
        part = own if many == 1 else own.where(F.pmod(F.xxhash64(F.lower("text")), F.lit(many)) == k)
        yield Index([(x.item_id, x.text) for x in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word)``: the items that each row of ``docs`` holds.

    Of items with the same words the smallest item_id stands for all. Items without words, null texts and null item_ids
    match nothing; an item of fewer than five words must occur as it is. A null doc_id stays null; repeated rows each
    have their results. Texts of any length are searched whole. Columns other than doc_id and text are not read.
    """
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark, out = docs.sparkSession, None
    arrow(spark)
    schema = "doc_id long, item_id long, similarity double, first_word long"
    for index in passes(benchmark):
        told = spark.sparkContext.broadcast(index)

        def run(found: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in found:
                hits = told.value.search(b.column(1).to_pylist())
                rows = [(doc, item, *at) for doc, own in zip(b.column(0).to_pylist(), hits, strict=True) for item, at in sorted(own.items())]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns, whatever their names; rows with a null or empty text stay,
    repeated rows each count, and without items all stay."""
    spark, at, rows = docs.sparkSession, docs.columns.index("text"), numbered(docs)
    arrow(spark)
    for index in passes(benchmark):
        told = spark.sparkContext.broadcast(index)

        def run(found: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in found:
                hits = told.value.search(b.column(at).to_pylist())
                yield b.filter(pa.array([not x for x in hits], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*docs.columns)
