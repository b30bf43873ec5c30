import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselann.config import Metric
from tesselann.operators import candidates as C
from tesselann.operators import evaluate as E
from tesselann.operators import partition as P
from tesselann.operators.arrays import vectors_of
from tesselann.operators.knn import exact_knn
from tesselann.operators.rerank import padded, rerank, rerank_expression

# fixed values: 12 items hashed to 4 buckets in 3 repetitions
BUCKETS = ["223132211312", "100130113220", "020312122022"]


@pytest.fixture(scope="module")
def twelve(spark):
    return P.hash_partition(spark.range(12).withColumnRenamed("id", "item"), 3, 4)


def probes(spark):
    rows = [(0, r, k, b) for r, own in enumerate(([0, 1], [1, 2], [2, 3])) for k, b in enumerate(own)]
    return spark.createDataFrame(rows, "qid long, r int, k int, bucket int")


def test_partition(twelve):
    rows = twelve.orderBy("r", "item").collect()
    assert ["".join(str(x.bucket) for x in rows if x.r == r) for r in range(3)] == BUCKETS
    own = P.offsets(twelve, 3, 4).orderBy("r", "bucket").collect()
    assert [[x.start for x in own if x.r == r] for r in range(3)] == [[0, 0, 4, 9], [0, 4, 8, 10], [0, 3, 5, 11]]
    lists = {(x.r, x.bucket): x["items"] for x in P.posting_lists(twelve).collect()}
    assert lists[0, 1] == [3, 7, 8, 10] and (0, 0) not in lists
    assert P.histogram(twelve, 3, 4).where("r = 0 AND bucket = 0").first().n == 0


def test_candidates(spark, twelve):
    hits = C.probe(probes(spark), twelve)
    order = lambda mf, cap: [x.item for x in C.capped(hits, mf, cap, 3, strict=True).orderBy("pos").collect()]
    assert order(1, None) == [0, 3, 6, 7, 9, 10, 1, 5, 8, 11]
    assert order(2, None) == [3, 7, 10, 8] and order(2, 3) == [3, 7, 10]
    assert order(3, None) == [7, 10, 3] and order(4, None) == []
    one = hits.where("r = 0")
    assert sorted(x.item for x in C.candidates(one, 2, 1).collect()) == [3, 7, 8, 10]
    assert sorted(x.item for x in C.candidates(hits, 2, 3).collect()) == [3, 7, 8, 10]


def test_first_repetition_alone(spark):
    hits = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 0, 6)], "qid long, r int, k int, item long")
    assert [x.item for x in C.candidates(hits, 1, 2, strict=True).collect()] == [6]
    assert sorted(x.item for x in C.candidates(hits, 1, 2).collect()) == [5, 6]


def test_adaptive(spark):
    rows = [(0, r, 0, i) for i in range(12) for r in range(1 + (i < 3))] + [(1, 0, 0, 7)]
    got = C.adaptive(spark.createDataFrame(rows, "qid long, r int, k int, item long"), 2).collect()
    assert sorted((x.qid, x.threshold, x.item) for x in got) == [(0, 1, i) for i in range(12)] + [(1, 1, 7)]


def test_least_loaded(spark):
    prefs = [[0, 1], [0, 1], [0, 2], [0, 1], [1, 0], [2, 0], [0, 2], [0, 1]]
    loads = np.zeros(3, np.int64)
    assert P.least_loaded(np.array(prefs), loads).tolist() == [0, 1, 2, 0, 1, 2, 0, 1] and loads.tolist() == [3, 3, 2]
    df = spark.createDataFrame([(r, i, p) for r in (0, 1) for i, p in enumerate(prefs)], "r int, item long, choices array<int>")
    got = P.assign_least_loaded(df.repartition(3), 3).orderBy("r", "item").collect()
    assert [x.bucket for x in got] == [0, 1, 2, 0, 1, 2, 0, 1] * 2
    assert P.assign_least_loaded(df, 3, block=4).count() == 16


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=2, max_size=2), max_size=40))
def test_least_loaded_property(prefs):
    loads = np.zeros(5, np.int64)
    out = P.least_loaded(np.array(prefs, np.int64).reshape(-1, 2), loads)
    assert loads.sum() == len(prefs) and all(b in p for b, p in zip(out, prefs, strict=True))
    held = [0] * 5
    for b, p in zip(out, prefs, strict=True):
        assert b == min(p, key=lambda c: held[c])
        held[b] += 1


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_and_rerank(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float32) * rng.integers(1, 6, (60, 1)).astype(np.float32)
    x[7] = 0
    x[9] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vec array<float>")
    q = df.where("item % 7 = 0")
    want = {}
    d = x.astype(np.float64)
    for i in range(0, 60, 7):
        ip = d @ d[i]
        s = ip if metric is Metric.IP else 2 * ip - (d * d).sum(1) if metric is Metric.L2 else np.where((n := np.sqrt((d * d).sum(1)) * np.sqrt((d[i] ** 2).sum())) > 0, ip / np.where(n > 0, n, 1), -np.inf)
        want[i] = sorted(range(60), key=lambda k, s=s: (-round(float(s[k]), 9), k))[:5]
    read = lambda df: {i: [x.item for x in sorted(df.where(F.col("qid") == i).collect(), key=lambda x: x.rk)] for i in want}
    assert read(exact_knn(q, df, 5, metric)) == want
    every = q.select(F.col("item").alias("qid")).join(df.select("item"))
    for f in (rerank, rerank_expression):
        got = read(f(every, df, q, 5, metric))
        assert {i: v for i, v in got.items() if i != 7} == {i: v for i, v in want.items() if i != 7}


def test_edges(spark):
    df = vectors_of(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0, None])], "id long, v array<double>"), "id", "v")
    assert [x.item for x in df.collect()] == [1]
    with pytest.raises(Exception, match="other than 3"):
        vectors_of(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "id", "v", 3).collect()
    none = df.where("item < 0")
    assert exact_knn(none, df, 3, Metric.IP).count() == 0 and exact_knn(df, none, 3, Metric.IP).count() == 0
    found = spark.createDataFrame([(1, 1, 5, 0.5)], "qid long, rk int, item long, score double")
    assert [x.item for x in padded(found, df, 3).orderBy("pos").collect()] == [5, -1, -1]
    truth = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "qid long, rk int, item long")
    assert tuple(E.recall(found, truth, df, 2).first()) == (1, 1, 0.5)
    assert tuple(E.candidate_size(found, df.unionByName(df.withColumn("item", F.lit(9).cast("long")))).first()) == (1, 2, 0.5)
