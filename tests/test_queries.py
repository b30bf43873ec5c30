import importlib
import os
import sys

import duckdb
import pytest

from tesselann.config import Metric
from tesselann.operators.knn import exact_knn
from tesselann.plans import catalog
from tesselann.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(df[cols].itertuples(index=False, name=None))
    assert rows(a) == rows(b) and rows(a)
    assert [a[c].dtype for c in cols] == [b[c].dtype for c in cols]


def test_trained(spark, sf):
    got = QUERIES["trained_index_search"](spark, sf).toPandas()
    assert got.rk.between(1, 10).all() and not got.duplicated(["qid", "item"]).any() and set(got.qid) <= set(range(0, 500, 20))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_trained_recall(spark, size):
    """At least 0.9 of the exact neighbours, and not by reading nearly all items."""
    path = f"/root/testdata/{size}"
    v = catalog.embeddings(spark, path)
    q, n = catalog.asked(v), v.count()
    got = {(r.qid, r.item) for r in QUERIES["trained_index_search"](spark, path).collect()}
    want = {(r.qid, r.item) for r in exact_knn(q, v, 10, Metric.COSINE).collect()}
    recall, share = len(got & want) / len(want), catalog.trained(v).candidates(q, catalog.PROBED, catalog.MF).count() / (q.count() * n)
    print(f"{size}: recall {recall:.3f}, share {share:.3f}")
    assert recall >= 0.9 and share < 0.6


def test_entry_without_llm(monkeypatch):
    for name in ("tesselann.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.delitem(sys.modules, "tesselann.llm.queries", raising=False)
    import tesselann

    monkeypatch.delattr(tesselann, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
