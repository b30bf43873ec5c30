"""Bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the ascending array of the ``K`` smallest distinct 64-bit hashes of a text's shingles. Sketches merge: that
of a union is the bottom K of the sketches' union. They estimate resemblance, containment and distinct shingles.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import columns

#: Hashes in a sketch; words in a shingle.
K, WIDTH = 64, 5
SPACE = r"[\x20\x09-\x0D]+"


def once(value: Column, f) -> Column:
    """``f(value)`` where value is computed once a row, however often f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text: lower-cased words between white space; fewer than ``width`` make one shingle; none, no hash."""

    def hashes(w: Column) -> Column:
        many = F.size(w)
        each = F.transform(F.sequence(F.lit(0), many - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(many >= width, each).when(many > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    words = F.array_remove(F.split(F.lower(text), SPACE), "")
    return F.slice(F.sort_array(F.array_distinct(once(words, hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the union's bottom k, the share in both; two texts without words have 1."""
    # of a's and b's common hashes only those within the union's bottom k count
    share = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(once(merge(a, b, k), share))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def hexed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """``(*by, sketch)``: the sketches of each group of ``sketches (*by, sketch)`` merged; a hot group is cut to k hashes
    in each task before it is dealt out."""
    hashes = sketches.select(*by, F.explode_outer("sketch").alias("h")).distinct()
    low = hashes.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(F.col("h").asc_nulls_last()))).where(F.col("n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def dealt(rows: DataFrame, key: str, parts: int, tie: Column) -> DataFrame:
    """``rows`` with ``part int`` and ``ghost boolean``: contiguous ranges of ``key``, those of a key that fills several
    cut again by ``tie``, a hash. Rows go by descending key, then ascending tie; at the end of each range are, as ghosts,
    copies of the rows that the next range begins with (of the last, the first)."""
    steps = [i / parts for i in range(1, parts)]
    told = rows.agg(F.percentile_approx(key, steps, 10_000) if steps else F.lit([0])).first()
    times = Counter(told[0] or [])
    bounds = sorted(times)
    side = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + side] for i in range(0, len(bounds), side)] or [[]]
    coarse, typed = F.lit([x[-1] for x in fine[:-1]] or [2**63 - 1]), "array<array<bigint>>"
    row = F.size(F.filter(coarse, lambda b: b < F.col(key)))
    inner = F.size(F.filter(F.get(F.array(*(F.lit(x) if x else F.array() for x in fine)).cast(typed), row), lambda b: b < F.col(key)))
    # a key that is a bound more than once has that many ranges of its own, above the rest of its range
    own = [times[b] if times[b] > 1 else 0 for b in bounds] + [0]
    base = [0]
    for n in own:
        base.append(base[-1] + 1 + n)
    at, hot = (row * side + inner).cast("int"), any(own)
    pick = lambda xs, kind, i: F.get(F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>"), i)
    part = at
    if hot:
        turn = F.floor((tie.cast("double") + 2.0**63) / 2.0**64 * pick(own, "int", at)).cast("int")
        mine = (F.col(key) == pick([*bounds, None], "bigint", at)) & (pick(own, "int", at) > 0)
        part = pick(base, "int", at) + F.when(mine, pick(own, "int", at) - F.least(turn, pick(own, "int", at) - 1)).otherwise(0)
    place = F.struct(F.col(key).alias("k"), (F.bitwise_not(tie) if hot else F.lit(0).cast("long")).alias("t"))
    placed = rows.withColumn("part", part.cast("int")).withColumn("place", place)
    # at most a row for each range: where it begins
    heads = sorted((x.part, x.head.k, x.head.t) for x in placed.groupBy("part").agg(F.max("place").alias("head")).collect())
    size = max([0, *(p for p, *_ in heads)]) + 1
    head, first, above = [None] * size, [None] * size, [None] * size
    for i, (p, k, t) in enumerate(heads):
        head[p], first[p], above[p] = k, t, heads[(i + 1) % len(heads)][0]
    begins = (F.col("place.k") == pick(head, "bigint", F.col("part"))) & (F.col("place.t") == pick(first, "bigint", F.col("part")))
    copy = F.when(begins, F.struct(pick(above, "int", F.col("part")).alias("part"), F.lit(True).alias("ghost")))
    stay = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    return placed.withColumn("to", F.explode(F.array_compact(F.array(stay, copy)))).withColumn("part", F.col("to.part")).withColumn("ghost", F.col("to.ghost")).drop("to", "place")


def edited(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of each text, of its edited text, and how like they and the next document are.

    The next document has the next lower doc_id, or after the last the highest. Null texts count as empty, null doc_ids
    as lowest; rows with equal doc_id are in order of a hash of their text. The edited text is the text with its last
    third of code points replaced by as many of the next one's first (or all). One row for each row; a single row is its
    own next. Texts are dealt by ranges of doc_id once, and never meet in one task but for a range's; many rows of one
    doc_id, or without one, are dealt by ranges of that hash.
    """
    own = columns(docs, "doc_id", "text")
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = dealt(own, "key", min(4096, max(16, 4 * many)), F.xxhash64("text")).repartition("part")
    rows = rows.withColumn("sketch", sketch(F.col("text"), k, width)).withColumn("tie", F.xxhash64("text"))
    order = W.partitionBy("part").orderBy("ghost", F.col("key").desc(), "tie")
    rows = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where("NOT ghost")
    n = F.length("text")
    other = F.concat(F.expr("left(text, length(text) - int(length(text) div 3))"), F.expr("left(next.text, int(length(text) div 3))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), other.alias("other"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("other"), k, width))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("other").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_edited"), distinct(F.col("sketch"), k).alias("n_shingles"),
    )
