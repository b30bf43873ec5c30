import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselann.config import IndexConfig, Metric
from tesselann.operators import candidates as C
from tesselann.operators import evaluate as E
from tesselann.operators import model as M
from tesselann.operators import partition as P
from tesselann.operators.knn import exact_knn
from tesselann.operators import knn
from tesselann.operators.rerank import rerank, rerank_expression, scored
from tesselann.operators.train import RATE, Trainer, assignments, ended, initial, loss, rounds, train, training_log
from tesselann.plans.index import PartitionIndex
from tesselann.sources.npy import NpySource
from tesselann.sources.tables import append_metrics, cached, load_queries, load_truth, load_vectors, training_sample, with_norms
from tesselann.streaming.serve import serve


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return load_vectors(spark, f"{sf}/embeddings.parquet", dims=64).where("item < 200").repartition(3).cache()


@pytest.fixture(scope="module")
def index(vectors):
    config = IndexConfig("embeddings", 0, 2, 8, 3, 16)
    return PartitionIndex.build(vectors, config, Metric.COSINE, [M.formula_weights(r, 64, 16, 8) for r in range(3)])


def test_invariants(vectors, index):
    q = vectors.where("item % 20 = 0")
    n = P.histogram(index.assignment, 3, 8)
    assert [x.n for x in n.groupBy("r").agg(F.sum("n").alias("n")).collect()] == [200] * 3
    size = lambda topm, mf: index.candidates(q, topm, mf).count()
    assert size(1, 2) <= size(3, 2) <= size(8, 2) == 10 * 200
    assert size(4, 3) <= size(4, 2) <= size(4, 1) and size(4, 4) == 0
    truth = exact_knn(q, vectors, 10, Metric.COSINE)
    every = index.search(q, vectors, topm=8, mf=2)
    assert sorted(map(tuple, every.select("qid", "rk", "item").collect())) == sorted(map(tuple, truth.select("qid", "rk", "item").collect()))
    assert E.recall(every, truth, q, 10).first().recall == 1.0


def test_save_load(spark, index, tmp_path):
    index.save(f"file://{tmp_path}/i")
    other = PartitionIndex.load(spark, f"file://{tmp_path}/i")
    assert (other.config, other.metric) == (index.config, index.metric)
    assert sorted(map(tuple, other.assignment.collect())) == sorted(map(tuple, index.assignment.select("r", "item", "bucket").collect()))
    assert all(np.allclose(a.w1, b.w1) for a, b in zip(other.models, index.models, strict=True))


def test_learned_beats_hash(vectors):
    """Recall for each share of candidates read is above that of chance, and the partition does not collapse."""
    config = IndexConfig("embeddings", 30, 8, 16, 3, 64)
    own = PartitionIndex.learn(vectors, config, Metric.COSINE, neighbours=5, batch=50)
    q = vectors.where("item % 5 = 0")
    truth = exact_knn(q, vectors, 10, Metric.COSINE)
    cand = own.candidates(q, 3, 2)
    share = cand.count() / (40 * 200)
    assert E.recall(cand, truth, q, 10).first().recall / share > 1.3
    assert P.load_balance(own.assignment, 3, 16).agg(F.max("max_load")).first()[0] < 60


def small(epochs, rows=40):
    rng = np.random.default_rng(0)
    x, near = rng.normal(size=(rows, 6)).astype(np.float32), rng.integers(0, rows, (rows, 3)).astype(np.int32)
    return IndexConfig("x", epochs, 2, 4, 2, 8), np.arange(100, 100 + rows), x, near


def test_resume():
    """A run that goes on from an earlier end equals one without a break."""
    config, ids, x, near = small(10)
    whole = list(rounds(config, 0, ids, x, near, 16))
    assert [g[0] for g in whole] == [5, 10] and whole[1][3] < whole[0][3]
    epoch, state, bucket, _ = whole[0]
    again = list(rounds(config, 0, ids, x, near, 16, state | {"bucket": bucket}, epoch))
    assert [g[0] for g in again] == [10] and np.array_equal(again[0][2], whole[1][2]) and again[0][3] == whole[1][3]
    assert all(np.array_equal(again[0][1][n], a) for n, a in whole[1][1].items())


def test_train_tables(spark, tmp_path):
    config, ids, x, near = small(5)
    rows = train(spark, config, ids, x, near, 16)
    assert len(M.from_table(rows)) == 2
    own = assignments(rows, ids)
    assert own.where("epoch = 5").count() == 80 and own.agg(F.min("item")).first()[0] == 100
    assert training_log(rows).count() == 2 and training_log(rows).where("loss > 0 AND seconds > 0").count() == 2
    rows.write.parquet(f"{tmp_path}/t")
    longer = IndexConfig("x", 10, 2, 4, 2, 8)
    on = train(spark, longer, ids, x, near, 16, ended(spark.read.parquet(f"{tmp_path}/t")))
    want = train(spark, longer, ids, x, near, 16)
    for a, b in zip(M.from_table(on), M.from_table(want), strict=True):
        assert np.array_equal(a.w1, b.w1) and np.array_equal(a.b2, b.b2)


def test_gradients():
    """Against finite differences of the loss, in double precision."""
    rng = np.random.default_rng(1)
    w = M.Weights(*(rng.normal(size=s) for s in ((5, 7), (7,), (7, 4), (4,))))
    x, y = rng.normal(size=(6, 5)), (rng.random((6, 4)) < 0.3).astype(float)
    grads, mean = Trainer(w).gradients(x, y)
    assert mean == pytest.approx(loss(w.logits(x), y))
    plain = -(y * np.log(1 / (1 + np.exp(-w.logits(x)))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-w.logits(x))))).mean()
    assert mean == pytest.approx(plain)
    for n in M.LAYERS:
        a = getattr(w, n)
        for at in list(np.ndindex(a.shape))[:: max(1, a.size // 9)]:
            old, eps, found = a[at], 1e-6, []
            for d in (eps, -eps):
                a[at] = old + d
                found.append(loss(w.logits(x), y))
            a[at] = old
            assert grads[n][at] == pytest.approx((found[0] - found[1]) / (2 * eps), abs=1e-7)


def test_adam_and_start():
    """The first step of Adam moves each weight by the rate; initial weights stay within two deviations of 0.05."""
    w = initial(6, 8, 4, 1)
    values = np.concatenate([getattr(w, n).ravel() for n in M.LAYERS])
    assert np.abs(values).max() <= 0.1 + 1e-6 and 0.03 < values.std() < 0.06
    rng = np.random.default_rng(2)
    trainer = Trainer(w)
    before = {n: getattr(w, n).copy() for n in M.LAYERS}
    x, y = rng.normal(size=(9, 6)).astype(np.float32), np.eye(4, dtype=np.float32)[rng.integers(0, 4, 9)]
    grads, _ = trainer.gradients(x, y)
    trainer.step(x, y)
    # eps is added to the root of v before the correction of the moments
    step = lambda g: RATE * np.sqrt(1 - 0.999) / 0.1 * 0.1 * g / (np.sqrt(0.001 * g * g) + 1e-8)
    for n in M.LAYERS:
        assert np.allclose(before[n] - getattr(trainer.w, n), step(grads[n]), atol=1e-6)


def test_learn_again(spark, vectors, tmp_path):
    """The sample and its neighbours are computed once; a resumed index equals one learned at a stretch."""
    make = lambda epochs, work, **more: PartitionIndex.learn(vectors, IndexConfig("e", epochs, 4, 8, 2, 16), Metric.COSINE, sample=120, neighbours=5, batch=50, work=work, **more)
    make(5, f"file://{tmp_path}/a")
    on, whole = make(10, f"file://{tmp_path}/a", resume=True), make(10, f"file://{tmp_path}/b")
    assert all(np.array_equal(x.w2, y.w2) for x, y in zip(on.models, whole.models, strict=True))
    assert sorted(map(tuple, on.assignment.collect())) == sorted(map(tuple, whole.assignment.collect()))
    near = spark.read.parquet(f"file://{tmp_path}/a/sample-120-5-0")
    assert near.count() == 120 and near.where("size(near) = 5").count() == 120


def test_hashed_index(spark, vectors, tmp_path):
    config = IndexConfig("embeddings", 0, 1, 8, 3, 16)
    own = PartitionIndex.hashed(vectors, config, Metric.COSINE)
    own.save(f"file://{tmp_path}/h")
    other = PartitionIndex.load(spark, f"file://{tmp_path}/h")
    q = vectors.where("item % 20 = 0")
    found = [sorted(map(tuple, i.search(q, vectors, mf=3).select("qid", "rk", "item").collect())) for i in (own, other)]
    assert found[0] == found[1] and {(x, 1, x) for x in range(0, 200, 20)} <= set(found[0])


def test_best_columns(monkeypatch):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 5, (50, 40)).astype(float)
    for k in (1, 3, 39, 40):
        assert np.array_equal(M.best_columns(s, k), np.argsort(-s, axis=1, kind="stable")[:, :k])
    w = M.formula_weights(0, 6, 5, 64)
    x = rng.normal(size=(33, 6))
    want = np.argsort(-w.logits(x), axis=1, kind="stable")[:, :4]
    held = []
    logits = M.Weights.logits
    monkeypatch.setattr(M, "SCORES", 64 * 5)
    monkeypatch.setattr(M.Weights, "logits", lambda self, x: held.append(len(x)) or logits(self, x))
    assert np.array_equal(w.top(x, 4), want) and max(held) == 5 and w.top(x[:0], 4).shape == (0, 4)


@pytest.mark.parametrize("metric", list(Metric))
def test_rerank_in_blocks(vectors, index, metric, monkeypatch):
    q = vectors.where("item % 3 = 0")
    found = index.candidates(q, 3, 2)
    rows = lambda v: sorted((x.qid, x.rk, x.item, round(x.score, 9)) for x in rerank(found, v, q, 5, metric).collect())
    want = rows(vectors)
    assert len(want) > 200 and rows(with_norms(vectors)) == want
    monkeypatch.setattr(knn, "QUERIES", 16)
    assert rows(vectors) == want and rows(with_norms(vectors)) == want
    # one pass over candidates and vectors, however many blocks
    plan = lambda: rerank(found, vectors, q, 5, metric)._jdf.queryExecution().logical().toString().count("MapInArrow")
    many = plan()
    monkeypatch.setattr(knn, "QUERIES", 4)
    assert plan() == many


@pytest.mark.parametrize("metric", list(Metric))
def test_search_lists_no_pairs(spark, vectors, metric, monkeypatch):
    """The same rows as from a list of candidates, with copies, zero vectors, ids that come twice and several blocks."""
    more = [vectors.where("item % 3 = 0").withColumn("item", F.col("item") + 1000), vectors.where("item IN (7, 40)").withColumn("vec", F.reverse("vec"))]
    more += [vectors.where("item IN (11, 60)").select((F.col("item") + 2009).alias("item"), F.transform("vec", lambda x: x * 0).alias("vec"))]
    v = vectors.unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).cache()
    q = v.where("item % 20 = 0")
    config = IndexConfig("embeddings", 0, 2, 8, 3, 16)
    models = [M.formula_weights(r, 64, 16, 8) for r in range(3)]
    rows = lambda df: sorted(map(tuple, df.select("qid", "rk", "item").collect()))
    for own, topm, mf in ((PartitionIndex.build(v, config, metric, models), 3, 2), (PartitionIndex.build(v, config, metric, models), 8, 1), (PartitionIndex.hashed(v, config, metric), 1, 2)):
        want = rows(rerank_expression(own.candidates(q, topm, mf), v, q, 10, metric))
        with monkeypatch.context() as m:
            m.setattr(C, "probe", None)
            assert len(want) > 100 and rows(own.search(q, v, topm, mf, 10)) == want
            m.setattr(knn, "QUERIES", 16)
            assert rows(own.search(q, v, topm, mf, 10)) == want
    assert own.search(q.where("item < 0"), v, 1, 2, 10).count() == 0


def test_reranked_queries_list_no_pairs(spark, sf, monkeypatch):
    from tesselann.plans.catalog import QUERIES

    monkeypatch.setattr(C, "probe", None)
    assert all(QUERIES[f"rerank_{m.value}"](spark, sf).count() == 250 for m in Metric)


def test_pairs_held_at_once():
    """An item that most queries want is scored in pieces; scores of copies are equal wherever they stand."""
    rng = np.random.default_rng(0)
    q, x, ids = rng.normal(size=(3000, 8)), rng.normal(size=(40, 8)), np.arange(3000)
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(list(x), pa.list_(pa.float64())), pa.array([ids] * 40, pa.list_(pa.int64()))], ["item", "vec", "qids"])
    pieces = list(scored(ids, q, b, Metric.IP))
    assert max(p.num_rows for p in pieces) <= knn.PAIRS
    got = pa.Table.from_batches(pieces)
    assert np.allclose(got.column("score").to_numpy().reshape(40, 3000), x @ q.T) and got.column("item").to_numpy().reshape(40, 3000)[:, 0].tolist() == list(range(40))
    best = knn.Best(q, 5, Metric.COSINE)
    for lo in range(0, 400, 70):
        own = np.tile(x, (10, 1))[lo : lo + 70]
        best.add(own, np.arange(400)[lo : lo + 70], knn.inner(own, own))
    row, item, _ = best.held
    order = np.lexsort((item, row))
    assert (item[order].reshape(3000, 5) % 40 == item[order].reshape(3000, 5)[:, :1] % 40).all()


def test_training_sample_is_bounded(spark, vectors, monkeypatch):
    """It learns from a part; every row is indexed."""
    from tesselann.plans import catalog

    seen = []
    sample = M.sample_rows
    monkeypatch.setattr(M, "sample_rows", lambda v, n, seed: seen.append(n) or sample(v, min(n, 60), seed))
    own = catalog.trained(vectors)
    assert seen == [20_000] and own.assignment.select("r", "item").distinct().count() == 200 * own.config.repetitions


def test_a_task_for_each_repetition(spark):
    rng = np.random.default_rng(0)
    rows = train(spark, IndexConfig("embeddings", 5, 2, 4, 8, 4), np.arange(20), rng.normal(size=(20, 6)), rng.integers(0, 20, (20, 3)).astype(np.int32), 10)
    assert rows.select("r", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().where("count = 1").count() == 8


def test_npy(spark, tmp_path):
    x = np.arange(50, dtype=np.float32).reshape(10, 5)
    np.save(tmp_path / "x.npy", x)
    x.tofile(tmp_path / "x.dat")
    spark.dataSource.register(NpySource)
    for options in ({"path": str(tmp_path / "x.npy")}, {"path": str(tmp_path / "x.dat"), "rows": "10", "dims": "5", "partitions": "3"}):
        rows = spark.read.format("npy").options(**options).load().orderBy("item").collect()
        assert [r.vec for r in rows] == x.tolist()


def test_npy_written(spark, vectors, tmp_path):
    spark.dataSource.register(NpySource)
    vectors.orderBy("item").write.format("npy").mode("append").option("path", f"{tmp_path}/m").save()
    back = spark.read.format("npy").option("path", f"{tmp_path}/m").load()
    key = lambda df: sorted((r.item, tuple(r.vec)) for r in df.collect())
    assert key(back) == key(vectors)
    whole = np.concatenate([np.load(f) for f in sorted(tmp_path.glob("m/*.npy"))])
    assert whole.tolist() == [list(r.vec) for r in vectors.orderBy("item").collect()] and not list(tmp_path.glob("m/*.raw"))


def test_cached_and_metrics(spark, tmp_path):
    calls = []
    for _ in range(2):
        assert cached(spark, f"file://{tmp_path}/t", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
    append_metrics(spark, f"file://{tmp_path}/m", "a", recall=1, size=2)
    append_metrics(spark, f"file://{tmp_path}/m", "b", recall=0.5)
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 3


def test_serve(spark, vectors, index, tmp_path):
    vectors.where("item % 50 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/in")
    serve(stream, index, vectors, f"{tmp_path}/out", f"{tmp_path}/cp", topm=8, mf=2, k=3, once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_tables(spark, vectors, tmp_path):
    vectors.select(F.col("item").alias("qid"), "vec").write.parquet(f"{tmp_path}/q")
    assert [x.item for x in load_queries(spark, f"{tmp_path}/q", first=3).orderBy("item").collect()] == [0, 1, 2]
    spark.createDataFrame([(1, [5, 6])], "qid long, nn_ids array<bigint>").write.parquet(f"{tmp_path}/t")
    assert [tuple(x) for x in load_truth(spark, f"{tmp_path}/t").orderBy("rk").collect()] == [(1, 1, 5), (1, 2, 6)]
    assert all(abs(x.norm - 1) < 1e-6 for x in with_norms(vectors).collect())
    rows = training_sample(vectors, 50).orderBy("train_id").collect()
    assert [x.train_id for x in rows] == list(range(50)) and [x.item for x in rows] == sorted(x.item for x in rows)


def test_command_line(spark, vectors, tmp_path):
    from tesselann import cli

    vectors.where("item < 60").withColumnsRenamed({"item": "vec_id", "vec": "embedding"}).write.parquet(f"{tmp_path}/v")
    common = ["--index", "x_epc5_K2_B4_R2", "--vectors", f"{tmp_path}/v", "--path", f"file://{tmp_path}/i", "--hidden", "8"]
    cli.main(["learn", *common, "--neighbours", "5", "--batch", "20", "--work", f"file://{tmp_path}/w", "--metrics", f"{tmp_path}/l"])
    cli.main(["learn", *common, "--neighbours", "5", "--batch", "20", "--work", f"file://{tmp_path}/w", "--resume", "--block", "16"])
    assert {x.metric for x in spark.read.parquet(f"{tmp_path}/l").collect()} == {"learn_seconds", "loss_5"}
    cli.main(["query", *common, "--queries", f"{tmp_path}/v", "--topm", "4", "--first", "7", "--cap", "3", "--no-rerank", "--out", f"{tmp_path}/c"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 21
    cli.main(["query", *common, "--queries", f"{tmp_path}/v", "--topm", "4", "--out", f"{tmp_path}/o", "--metrics", f"{tmp_path}/m"])
    assert spark.read.parquet(f"{tmp_path}/o").count() == 600
    told = {x.metric: x.value for x in spark.read.parquet(f"{tmp_path}/m").collect()}
    assert told.pop("query_seconds") > 0 and told == {"recall": 1.0, "candidates": 60.0}
