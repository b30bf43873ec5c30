"""Sharding and bottom-k sketches."""

import hashlib
import zlib
from os.path import commonprefix

import pytest
from pyspark.sql import functions as F

from tesselann.llm import bottomk as B
from tesselann.llm import hilbert as H


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_curve(dims, bits):
    cells = H.curve(dims, bits)
    assert sorted(cells) == list(range(1 << dims * bits))
    at = {index: [cell >> (bits * d) & ((1 << bits) - 1) for d in range(dims)] for cell, index in enumerate(cells)}
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def check_shards(rows, many):
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    n = [len(sizes.get(k, [])) for k in range(many)]
    assert max(n) - min(n) <= 1 and set(sizes) <= set(range(many))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_shards(spark, sample, clashing):
    rows = H.shards(sample, 24).collect()
    check_shards(rows, 24)
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()), "rows", None) for r in rows)
    again = {tuple(r) for r in H.shards(sample.repartition(7), 24).collect()}
    assert again == {tuple(r) for r in rows}
    odd = H.shards(clashing, 4).collect()
    assert len(odd) == 11
    check_shards(odd, 4)
    assert sorted(r["size"] for r in odd if r.doc_id in (2, 3)) == [8, 8]
    assert H.shards(sample.where("doc_id < 0"), 4).count() == 0
    assert len(H.shards(sample.limit(2), 24).collect()) == 2


def test_place_on_the_curve(sample):
    """Recomputed row by row: categories by the cuts of their own order, counts by powers of two."""
    rows = sample.collect()
    cells = H.curve(3, H.BITS)

    def places(values):
        code = lambda v: int.from_bytes(v.encode()[same : same + 7].ljust(7, b"\0"), "big")
        same = len(commonprefix([min(values).encode(), max(values).encode()]))
        own = sorted(map(code, values))
        # the smallest value that a share i / 16 of the rows doesn't exceed
        cuts = sorted({own[max(0, -(-len(own) * i // 16) - 1)] for i in range(1, 16)})
        return {v: sum(code(v) > c for c in cuts) * 15 // max(1, len(cuts)) for v in set(values)}

    lang, source = places([r.lang for r in rows]), places([r.source for r in rows])
    want = {r.doc_id: cells[lang[r.lang] | source[r.source] << 4 | min(15, (r.n_chars + 1).bit_length() - 1) << 8] for r in rows}
    assert {r.doc_id: r.curve for r in H.shards(sample, 24).collect()} == want


def test_hot_rows(spark, docs_of, monkeypatch):
    """Very many equal rows, with and without doc_id, are dealt without gaps."""
    monkeypatch.setattr(H, "EACH", 7)
    docs = docs_of([(1, "same")] * 300 + [(None, "none")] * 200 + [(i, f"t{i}") for i in range(50)])
    rows = H.shards(docs, 6).collect()
    check_shards(rows, 6)
    assert len(rows) == 550 and sum(r.doc_id == 1 for r in rows) == 301 and sum(r.doc_id is None for r in rows) == 200


def test_pruning(spark):
    """A filter on any dimension reads a part of the shards; of shards by hash it reads nearly all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    dealt = H.shards(docs, 24)
    share = lambda own, col, v: ((own[f"{col}_low"] <= v) & (v <= own[f"{col}_high"])).mean()
    mean = lambda own, col: sum(share(own, col, r[0]) for r in kinds[col]) / len(kinds[col])
    kinds = {c: docs.select(c).distinct().collect() for c in ("lang", "source")}
    own = H.ranges(docs, dealt, "lang", "source", "n_chars").toPandas()
    apart = H.ranges(docs, dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(24))), "lang", "source", "n_chars").toPandas()
    assert mean(apart, "lang") > 0.99 and mean(apart, "source") > 0.99 and (apart.n_chars_high > 8000).mean() == 1
    assert mean(own, "lang") < 0.6 and mean(own, "source") < 0.4 and (own.n_chars_high > 8000).mean() < 0.4


def words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_edited(sample):
    rows = sorted(B.edited(sample).collect(), key=lambda r: -r.doc_id)
    texts = [r.text for r in sample.orderBy(F.desc("doc_id")).collect()]
    wrong = []
    for i, r in enumerate(rows):
        k = len(texts[i]) // 3
        other = texts[i][: len(texts[i]) - k] + texts[(i + 1) % len(texts)][:k]
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest() and r.n_chars == len(texts[i])
        a, b, c = words(texts[i]), words(other), words(texts[(i + 1) % len(texts)])
        wrong += [abs(len(a & x) / max(1, len(a | x)) - got) for x, got in ((b, r.near_edited), (c, r.near_next)) if a | x]
        if len(a) < B.K:
            assert len(r.sketch) == len(a) == r.n_shingles
    assert sum(wrong) / len(wrong) < 0.05 and max(wrong) < 0.3


def test_estimates(spark):
    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(3004)), " ".join(f"a{i}" for i in range(1000, 5004)))], "x string, y string")
    df = df.select(B.sketch(F.col("x"), 512).alias("a"), B.sketch(F.col("y"), 512).alias("b"), B.sketch(F.concat_ws(" ", "x", "y"), 512).alias("c"))
    r = df.select(B.resemblance(F.col("a"), F.col("b"), 512), B.containment(F.col("a"), F.col("b"), 512), B.distinct(F.col("a"), 512), B.merge(F.col("a"), F.col("b"), 512).alias("m"), "c").first()
    assert abs(r[0] - 0.4) < 0.07 and abs(r[1] - 2 / 3) < 0.12 and abs(r[2] - 3000) < 400
    assert len(set(r.m) ^ set(r.c)) <= 4


def test_merged(spark):
    rows = [("x", [1, 5, 9]), ("x", [2, 5]), ("y", []), ("y", [7])]
    got = {r.g: r.sketch for r in B.merged(spark.createDataFrame(rows, "g string, sketch array<bigint>"), ["g"], 3).collect()}
    assert got == {"x": [1, 2, 5], "y": [7]}


def test_odd(clashing, docs_of):
    rows = B.edited(clashing).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].sketch == by[8][0].sketch and by[2][0].sketch == by[4][0].sketch == []
    assert B.edited(docs_of([])).count() == 0
    one = B.edited(docs_of(["a b c d e f g h i"])).first()
    assert one.near_next == 1.0


def test_hot_ids(docs_of):
    """Many texts under one doc_id, and without one, are cut by their hash; each row's next is the next in order."""
    rows = [(5, f"many words number {i} of one id") for i in range(300)] + [(None, f"no id at all {i}") for i in range(200)] + [(i, f"one text {i}") for i in range(6, 60)] + [(5, "twice"), (5, "twice")]
    docs = docs_of(rows)
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    order.sort(key=lambda r: (-(r.doc_id if r.doc_id is not None else -(2**63)), r.tie))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        k = len(a.text) // 3
        want.append((a.doc_id, hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest()))
    got = B.edited(docs)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in got.collect())
    parts = B.dealt(docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))), "key", 16, F.xxhash64("text")).where("NOT ghost").groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts < 120
