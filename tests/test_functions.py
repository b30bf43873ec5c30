import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselann.config import DATASETS, IndexConfig, Metric
from tesselann.functions import hashing as H
from tesselann.functions import vectors as V

# fixed values: signed MurmurHash3 of 0..7 under seeds 0..3
GOLDEN = [
    [593689054, -68075478, 1085422463, 847579505, 1889779975, 236698494, -975490194, 1343918321],
    [2028806445, 1578231156, -610632052, -814954327, 1445381879, 1808298432, 1861473041, -706856059],
    [115322364, 332615954, 752811296, -569461109, 492697557, 897918110, -1590993799, 1359117114],
    [519245393, 834474203, 1628553173, 270812492, 1133932253, -50564550, 514300034, -997398897],
]


def test_murmur(spark):
    rows = spark.range(8).select(*(H.murmur3_seeded(F.col("id"), r).alias(f"h{r}") for r in range(4)), "id").orderBy("id").collect()
    assert [[x[f"h{r}"] for x in rows] for r in range(4)] == GOLDEN
    assert [H.murmur3(i, r) for r in range(4) for i in range(8)] == [x & H.M for g in GOLDEN for x in g]


def test_wide_ids_have_buckets(spark):
    df = spark.createDataFrame([(2**40,), (-5,), (None,)], "id long")
    assert {x.b in range(7) or x.id is None for x in df.select("id", H.hash_bucket(F.col("id"), 1, 7).alias("b")).collect()} == {True}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(V.norm("a").alias("n"), V.normalised("a").alias("u"), *(V.score("b", "a", m).alias(m.value) for m in Metric), V.score("b", "a", Metric.L2, True).alias("plain")).collect()
    assert (rows[0].n, rows[0].u, rows[0].ip, rows[0].l2, rows[0].plain) == (5.0, [0.6, 0.8], 11.0, 22.0 - 25.0, 22.0 - 5.0)
    assert np.isclose(rows[0].cosine, 11 / 5 / 5**0.5)
    assert rows[1].cosine is None and rows[1].u == [None, None]


def test_config():
    c = IndexConfig.parse("FB_ssnpp-1b_epc20_K2_B4096_R4")
    assert (c.dataset, c.epochs, c.choices, c.buckets, c.repetitions) == ("FB_ssnpp-1b", 20, 2, 4096, 4)
    assert IndexConfig.parse(c.name) == c
    assert IndexConfig("glove").cap(DATASETS["glove"].rows, 50, 2) == 57344 and IndexConfig("glove").cap(DATASETS["glove"].rows, 10, 2) == 11264
    for bad in (dict(epochs=7), dict(buckets=0), dict(choices=9, buckets=8)):
        with pytest.raises(ValueError):
            IndexConfig("x", **bad)
    with pytest.raises(ValueError):
        IndexConfig.parse("glove")
