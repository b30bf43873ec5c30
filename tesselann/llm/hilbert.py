"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Rows near each other on the curve are near each other in every dimension, so that each shard, a run of the curve, covers
a narrow range of all of them, and a reader can skip the shards whose ranges do not meet its filter.
"""

from __future__ import annotations

from functools import lru_cache
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import columns, few

#: Bits of each dimension; parts of a curve cell that are ranked apart, so that no cell has to fit one task.
BITS, PARTS = 4, 256
#: Equal rows that are made in one piece.
EACH = 65_536


@lru_cache
def curve(dims: int, bits: int) -> list[int]:
    """The Hilbert index of every cell; cell ``sum(x[d] << (bits * d))`` has the coordinates x.

    Goes from the top bit down: the bits of a level, read as a Gray code, give the orthant's place; the orthant's entry
    point and direction turn the frame of the levels below.
    """
    rotate = lambda x, by: ((x >> by) | (x << (dims - by))) & ((1 << dims) - 1)
    out = []
    for cell in range(1 << (dims * bits)):
        entry = axis = index = 0
        for level in reversed(range(bits)):
            orthant = sum(((cell >> (bits * d + level)) & 1) << d for d in range(dims))
            gray = rotate(orthant ^ entry, (axis + 1) % dims)
            place = gray
            shift = 1
            while shift < dims:
                place ^= place >> shift
                shift <<= 1
            index = index << dims | place
            even = 0 if place == 0 else 2 * ((place - 1) // 2)
            back = (axis + 1) % dims
            turn = even ^ (even >> 1)
            entry ^= rotate(turn, (dims - back) % dims)
            flips = place if place & 1 else max(0, place - 1)
            ones = 0
            while flips & 1:
                ones, flips = ones + 1, flips >> 1
            axis = (axis + ones % dims + 1) % dims
        out.append(index)
    return out


def ordered(rows: DataFrame, col: str) -> Column:
    """A category's coordinate, in its own order: categories are cut into runs of about as many rows, so that each shard has
    a narrow range of them. They are told apart by the seven bytes after what all of them begin with; null has 0."""
    raw = F.col(col).cast("string").cast("binary")
    ends = rows.agg(F.min(raw).alias("a"), F.max(raw).alias("b")).first()
    same = len(commonprefix([bytes(ends.a or b""), bytes(ends.b or b"")]))
    code = F.conv(F.rpad(F.hex(F.expr(f"substring(cast(cast(`{col}` as string) as binary), {same + 1}, 7)")), 14, "0"), 16, 10).cast("long")
    cuts = rows.where(F.col(col).isNotNull()).agg(F.percentile_approx(code, [i / (1 << BITS) for i in range(1, 1 << BITS)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    # few categories lie as far apart as many
    place = F.floor(sum((F.when(code > c, 1).otherwise(0) for c in cuts), F.lit(0)) * ((1 << BITS) - 1) / max(1, len(cuts))).cast("int")
    return F.coalesce(F.when(F.col(col).isNotNull(), place), F.lit(0))


def magnitude(col: str) -> Column:
    """A count's coordinate: the power of two below it; null and negative have 0."""
    return F.coalesce(F.least(F.floor(F.log2(F.greatest(F.col(col), F.lit(0)) + 1)).cast("int"), F.lit((1 << BITS) - 1)), F.lit(0))


def shards(docs: DataFrame, many: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)``, a row for each row of ``docs``.

    Dimensions: lang, source and n_chars. Law ``rows``: shards are runs of the curve whose counts differ by one at most;
    slot counts a shard's rows from 0. size is the text's bytes plus 8 (null: 8), text_crc32 that of the text (null: of
    no bytes). Null metadata has the lowest coordinate. Within a cell, rows are in order of a hash of doc_id, checksum and
    size, then these. An empty table gives an empty result; columns other than the five are not read.

    Rows equal in place, doc_id, checksum and size are interchangeable: they are counted where they are read, ranked as
    one, and dealt out again by ``EACH``, so that no key is too hot for a task. A rank is a number within a hashed part of
    a cell, plus the count of all that stands before that part. Counts are at most ``4096 * PARTS``; the sum over whole
    cells is the one step in a single task, over 4096 rows at most.
    """
    own = columns(docs, "doc_id", "text", "lang", "source", "n_chars")
    dims = [ordered(own.select("lang"), "lang"), ordered(own.select("source"), "source"), magnitude("n_chars")]
    cell = sum((d * (1 << (BITS * i)) for i, d in enumerate(dims)), F.lit(0))
    at = F.get(F.lit(curve(len(dims), BITS)), cell).alias("curve")
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), at)
    key = ["curve", "part", "doc_id", "text_crc32", "size"]
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")
    kinds = few(rows.withColumn("part", part).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))

    counts = kinds.groupBy("curve", "part").agg(F.sum("n").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n"))
    up = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    inner = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("curve", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("within")).join(cells, "curve")

    number = F.coalesce(F.sum("n").over(W.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = kinds.withColumn("number", number).join(starts, ["curve", "part"])
    ranked = ranked.withColumn("first", F.col("before") + F.col("within") + F.col("number")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EACH).cast("long"))))
    # the rows of a kind that has very many are made by several tasks
    ranked = ranked.select("doc_id", "size", "text_crc32", "curve", "n", "first", "at", "total")
    ranked = ranked.where(F.col("n") <= EACH).unionByName(ranked.where(F.col("n") > EACH).repartition("doc_id", "at"))
    one = F.explode(F.sequence(F.col("at"), F.least(F.col("n"), F.col("at") + EACH) - 1))
    ranked = ranked.withColumn("rank", one).withColumn("rank", F.col("rank") + F.col("first"))
    each, extra = F.expr(f"total div {many}"), F.expr(f"total % {many}")
    ranked = ranked.select("doc_id", "size", "text_crc32", "curve", "rank", each.alias("each"), extra.alias("extra"))
    long = F.col("extra") * (F.col("each") + 1)  # rows in the shards that have one more
    shard = F.when(F.col("rank") < long, F.expr("rank div (each + 1)")).otherwise(F.expr("extra + (rank - extra * (each + 1)) div each"))
    ranked = ranked.withColumn("shard", shard)
    slot = F.col("rank") - F.col("shard") * F.col("each") - F.least("shard", "extra")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def ranges(docs: DataFrame, dealt: DataFrame, *by: str) -> DataFrame:
    """``(shard, <col>_low, <col>_high, ...)``: what a reader prunes by, for rows with a doc_id of their own."""
    own = columns(docs, "doc_id", *by).join(dealt.select("doc_id", "shard"), "doc_id")
    return own.groupBy("shard").agg(*(f(c).alias(f"{c}_{n}") for c in by for f, n in ((F.min, "low"), (F.max, "high"))))
