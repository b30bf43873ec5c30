"""Packing token sequences by minimum bin slack.

Documents longer than a window give full windows and a rest. Rests are packed by the multiset of their lengths alone,
which has at most ``WINDOW`` entries however many documents there are: the longest remaining length opens a window, a
subset-sum over the remaining counts, with sums as the bits of one integer, finds the fill closest to capacity, and
walking back through its steps gives the counts. The same fill is repeated as often as the counts allow, until some
length has less left than the fill takes; as that at least halves what a length has left, the plan's size depends on
``WINDOW`` alone, not on the number of pieces. Rows find their place in it by their rank among the pieces of the same
length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import arrow, columns, kept

WINDOW, END = 2048, 1
SPECIAL = "<|endoftext|>"
#: White space in a row from which on the exact tokenizer reads a text.
RUN = 1 << 14
BLANKS = re.compile(rf"\s{{{RUN}}}")


@lru_cache
def encoder(name: str = "byte_bpe_50k"):
    """Ids of a text by the public tokenizer ``name``. The rank file has the same vocabulary and merges as the tokenizer
    file and is read several times faster. Texts that hold the special token's string need the latter, and so do those
    with a very long run of white space, on which the former's pattern runs out of stack."""
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(f"{name}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list = []

    def encode(text: str) -> list[int]:
        if SPECIAL not in text and not (len(text) > RUN and BLANKS.search(text)):
            return fast.encode_ordinary(text)
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(public.path(f"{name}.json")))
        return exact[0].encode(text, add_special_tokens=False).ids

    return encode


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of ``counts`` (length: how many) whose sum is largest within ``room``; longer lengths first."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            left, take = left - take, take * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] += take
    return dict(out)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Fills and how often each is used, until ``counts`` are used up."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        own = Counter({longest: 1})
        left[longest] -= 1
        own.update(fill({k: n for k, n in left.items() if n}, window - longest))
        left[longest] += 1
        times = min(left[k] // n for k, n in own.items())
        out.append((dict(own), times))
        left = {k: m for k, n in left.items() if (m := n - own.get(k, 0) * times)}
    return out


def places(fills: list[tuple[dict[int, int], int]], window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, pieces a sequence, first sequence, offset)`` by rank."""
    out: dict[int, list] = {}
    ranks, sequence = Counter(), 0
    for own, times in fills:
        offset = 0
        for length in sorted(own, reverse=True):
            out.setdefault(length, []).append((ranks[length], own[length], sequence, offset))
            ranks[length] += own[length] * times
            offset += own[length] * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, window: int = WINDOW, encode=None) -> DataFrame:
    """Documents cut into full windows and a rest, with each piece's task and its number among that task's pieces of its
    length. A null text counts as empty and has only the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen = encode or encoder(), Counter()
        task = TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(text or ""), END], "<u4")
                for at in range(0, len(ids), window):
                    own = ids[at : at + window]
                    rows.append((doc, at, len(own), zlib.crc32(own.tobytes()), len(ids), task, seen[len(own)]))
                    seen[len(own)] += 1
            cols = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"])

    arrow(docs.sparkSession)
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long")


def pack(docs: DataFrame, window: int = WINDOW, encode=None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row for each piece of ``docs``.

    Sequences and offsets are gapless from 0. Texts may be of any length; rows that repeat, in doc_id or in all, are
    packed each; a null doc_id stays null. An empty table gives an empty result. Columns other than doc_id and text are
    not read. The pieces are written to the shared folder first, so that a lost task cannot renumber them.
    """
    cut = kept(pieces(docs, window, encode))
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `window` rows
    where = places(plan({x.length: x.n for x in totals}, window), window)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.nonzero(length == n)[0]
                first, each, start, off = where[int(n)][np.searchsorted(where[int(n)][:, 0], rank[own], "right") - 1].T
                sequence[own], offset[own] = start + (rank[own] - first) // each, off + (rank[own] - first) % each * n
            cols = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("number"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
