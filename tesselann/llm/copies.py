"""Near copies by the Jaccard similarity of five-word shingles: fingerprint and minima candidates, exact verification.

Texts whose sets of shingles are at least ``SIMILAR`` alike are linked, and components of links are the groups. Sets are
compared where they share a bucket. A bucket is a group of 64-bit SimHash fingerprints that vantage-point trees link at
``RADIUS`` bits, or those sets whose ``ROWS`` minima of one of ``BANDS`` bands agree. At a similarity of 0.8 fingerprints
differ in ten bits on average, further than any tree over them can prune, so that the trees find the nearer copies and
the bands the rest: all bands miss a pair at 0.8 with probability 0.00003. Every pair of a bucket is compared exactly.

No bucket has to fit one task. A large one is cut into chunks, and each chunk is compared within itself and with the
bucket's leader. What the leader's group took in needs no more comparing among itself; what it did not is compared with
all chunks, in blocks.
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
from .filters import all_within, bloom
from .kernels import mixed
from .shared import arrow, few, kept, numbered
from .simhash import linked, majority

WIDTH, SIMILAR, RADIUS = 5, 0.8, 3
BANDS, ROWS = 20, 4
#: Shingles whose minima are taken at once; shingles of a chunk, about.
BLOCK, CHUNK = 1 << 14, 1 << 20
SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of all shingles; words as in ``simhash``. A text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    many = max(1, len(words) - width + 1)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, many)


def name(s: np.ndarray) -> int:
    """A hash of the whole set; zero for the empty one."""
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of the set's minima; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), BLOCK):
        low = np.minimum(low, mixed(s[i : i + BLOCK][None, :] ^ SEEDS[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ low[:, k]) + np.uint64(k)
    return key.view(np.int64)


def linked_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the position of the first of its component under similarity ``SIMILAR``, all pairs considered."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both >= SIMILAR * (len(sets[0]) + len(sets[1]) - both) - 1e-9 else 1])
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, at = np.repeat(np.arange(len(sets)), size), np.concatenate([[0], np.cumsum(size)])
    label, have = np.full(len(sets), -1), np.zeros(len(code), bool)
    left = np.arange(len(sets))  # sets without a component yet
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], todo = first, [first]
        while todo and len(left := left[label[left] < 0]):
            x = todo.pop()
            # sets that differ too much in size can't be alike
            near = left[(size[left] >= SIMILAR * size[x] - 1e-9) & (size[x] >= SIMILAR * size[left] - 1e-9)]
            if not len(near):
                continue
            own = code[at[x] : at[x + 1]]
            have[own] = True
            if 2 * len(near) < len(sets):
                same = np.array([have[code[at[k] : at[k + 1]]].sum() for k in near])
            else:
                same = np.bincount(owner[have[code]], minlength=len(sets))[near]
            have[own] = False
            new = near[same >= SIMILAR * (size[near] + size[x] - same) - 1e-9]
            label[new] = first
            todo += new.tolist()
    return label


def compared(rows: DataFrame, group: list[str]) -> DataFrame:
    """``(a, b)``: links that span the components within each group of ``rows (*group, s, shingles)``."""
    many = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def links() -> pa.RecordBatch:
            at = np.unique(np.array(names), return_index=True)[1]  # a set that is there twice counts once
            label = linked_sets([sets[i] for i in at])
            moved = np.nonzero(label != np.arange(len(at)))[0]
            return pa.RecordBatch.from_arrays([pa.array([names[at[k]] for k in which], pa.int64()) for which in (moved, label[moved])], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(many)), strict=True))
            lists, ids = b.column(many + 1), b.column(many).to_pylist()
            for i, key in enumerate(keys):
                if key != now and names:
                    yield links()
                    names, sets = [], []
                now = key
                names.append(ids[i])
                sets.append(lists[i].values.to_numpy().view(np.uint64))
        if names:
            yield links()

    placed = rows.select(*group, "s", "shingles").repartition(*group).sortWithinPartitions(*group)
    return placed.mapInArrow(run, "a long, b long")


def groups(own: DataFrame, prints: DataFrame) -> DataFrame:
    """``(low struct<doc_id, th>, root)`` for each distinct set of ``prints (doc_id, th, s, n, fp, keys)``: its first row
    and its component; ``own (doc_id, th, text)`` are the texts."""
    # the first row of each distinct set stands for it
    first = prints.groupBy("s").agg(F.min(F.struct("doc_id", "th")).alias("low"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "keys")))
    sets = few(first)
    trees = linked(few(sets.where("s <> 0").select("fp").distinct()), RADIUS)
    near = sets.where("s <> 0").join(trees, F.col("fp") == F.col("node"), "left")
    keys = sets.select("s", "n", F.explode("keys").alias("key")).unionByName(near.select("s", "n", F.xxhash64(F.lit("trees"), F.coalesce("root", "fp")).alias("key")))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("s").alias("lead"), F.bit_xor(F.xxhash64("s")).alias("all"), F.sum("n").alias("n"))
    # buckets of the same members are compared once
    buckets = buckets.where("many > 1").groupBy("many", "lead", "all").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    buckets = few(buckets.select("key", "lead", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    members = few(keys.select("s", "n", "key").join(buckets, "key"))

    # only texts that are in a bucket leave their task, as their shingles
    wanted = few(members.select("s").distinct().join(sets, "s").select(F.xxhash64("low.doc_id", "low.th").alias("t"), "s", "low.doc_id", "low.th"))
    told = own.sparkSession.sparkContext.broadcast(bloom(wanted.select("t")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(told.value, np.uint8), set()
        for b in batches:
            t = b.column(0).to_numpy()
            at = [i for i in np.nonzero(all_within(t, bits))[0].tolist() if (k := int(t[i])) not in seen and not seen.add(k)]
            own = b.take(pa.array(at, pa.int64()))
            found = pa.array([np.unique(shingle_hashes(x)).view(np.int64) for x in own.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[1:3], found], ["doc_id", "th", "shingles"])

    marked = own.select(F.xxhash64("doc_id", "th").alias("t"), "doc_id", "th", "text")
    found = marked.mapInArrow(shingled, "doc_id long, th long, shingles array<long>").join(wanted, ["doc_id", "th"])
    shingles = kept(found.select("s", "shingles").dropDuplicates(["s"]))
    chunk = F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int")
    # a leader is in every chunk of its bucket
    spots = F.when(F.col("s") == F.col("lead"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    links = few(compared(members.select("key", "s", F.explode(spots).alias("chunk")).join(shingles, "s"), ["key", "chunk"]))
    large = members.where("chunks > 1")
    if not large.isEmpty():
        roots = components(links)
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        at = large.join(root("s"), "s", "left").join(root("lead"), "lead", "left")
        apart = few(at.where(F.coalesce("s_root", "s") != F.coalesce("lead_root", "lead")).select("key", "s", "n", "chunks", chunk.alias("chunk")))
        blocks = apart.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("blocks"))
        all_ = large.join(blocks, "key").select("key", "s", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        block = F.pmod(F.xxhash64("s", F.lit(1)), F.col("blocks")).cast("int").alias("block")
        own_ = apart.join(blocks, "key").select("key", "s", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), block)
        rest = all_.unionByName(own_).distinct().join(shingles, "s")
        links = links.unionByName(few(compared(rest, ["key", "chunk", "block"])))
    return sets.select("s", "low").join(components(links), F.col("s") == F.col("node"), "left").select("low", F.coalesce("root", "s").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id. Texts without words, null ones
    too, are one group. Rows that repeat a doc_id with another text each count, equal rows once; rows without doc_id stay.
    An empty table gives an empty one. Columns of any name are carried."""
    arrow(docs.sparkSession)
    names = docs.columns
    rows = numbered(docs)
    doc, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    rows = rows.withColumns({"doc_id": doc.cast("long"), "th": F.xxhash64(text.cast("string"))})
    own = rows.where("doc_id IS NOT NULL").select("doc_id", "th", text.cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(x) for x in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            cols = [pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "th", "s", "n", "fp", "keys"])

    prints = own.mapInArrow(run, "doc_id long, th long, s long, n long, fp long, keys array<long>")
    stay = groups(own, prints).groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.th")
    # equal rows meet in their own tasks first, so that none has to take a hot group whole
    once = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "th"]).join(stay, ["doc_id", "th"], "left_semi")
    inner = [f"c{i}" for i in range(len(names))]
    return once.select(*inner).unionByName(rows.where("doc_id IS NULL").select(*inner)).toDF(*names)
