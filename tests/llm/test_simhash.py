import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselann.llm import simhash as S
from tesselann.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, radius=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    roots = [find(i) for i in range(len(fps))]
    return [min(ids[k] for k in range(len(fps)) if roots[k] == r) for r in roots]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\té", max_size=60))
def test_fingerprint(text):
    assert S.simhash(text) == plain(text)
    assert S.simhash(text, block=2) == plain(text)


def test_whole_table(spark, sample):
    got = S.near_duplicates(sample).toPandas().sort_values("doc_id")
    rows = sample.orderBy("doc_id").collect()
    fps = [plain(r.text) for r in rows]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == groups(fps, [r.doc_id for r in rows])


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_link(seed):
    """Dense clusters, chains and noise, through small leaves."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))) for c in x[:20] for _ in range(20)]
    ball = [x[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(30) for j in range(i)]
    x = np.unique(np.concatenate([x, np.array(near + ball, np.uint64)]))
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[np.nonzero(np.bitwise_count(x[i + 1 :] ^ a) <= 3)[0] + i + 1]}
    found = set()
    for mask in S.HALVES:
        nodes = S.plant(x[:: 1 + seed % 2], mask, 1, 16)
        where, leaf = S.route(x, nodes, mask, 1)
        for k in np.unique(leaf):
            own = x[np.sort(where[leaf == k])]
            a, b = S.links(own, 3, mask, 1)
            label = {int(v): int(v) for v in own}
            for p, q in zip(a, b, strict=True):
                label[int(p)] = int(q)
            found |= {(p, q) for p in label for q in label if p < q and label[p] == label[q]}
    # what is joined by the leaves' links is what is joined by all true links
    def closed(pairs):
        up = {int(v): int(v) for v in x}

        def find(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return [find(int(v)) for v in x]

    assert closed(found) == closed(want)


def test_large_family():
    """A set that no centre splits, larger than one block of columns: a pair may lie in different blocks."""
    rng = np.random.default_rng(5)
    low = rng.choice(1 << 32, 5_000, replace=False).astype(np.uint64)
    flips = np.array([(1 << a) | (1 << b) for a, b in (rng.choice(32, 2, replace=False) for _ in range(2_500))], np.uint64)
    x = np.unique(np.concatenate([low, low[:2_500] ^ flips])) | np.uint64(0xABCD << 48)
    x = rng.permutation(x)
    a, b = S.links(x, 3, S.HALVES[0], 1)
    label = {int(v): int(v) for v in x}
    label.update(zip(a.tolist(), b.tolist(), strict=True))
    up = {int(v): int(v) for v in x}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for v in x:
        for w in x[np.bitwise_count(x ^ v) <= 3]:
            up[find(int(v))] = find(int(w))
    want = {}
    for v in x.tolist():
        want.setdefault(find(v), set()).add(v)
    got = {}
    for v, root in label.items():
        got.setdefault(root, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (22, 20), (5, 5), *((100, i) for i in range(101, 160)), *((i, i + 1) for i in range(200, 240))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    same = lambda *ids: len({got[i] for i in ids}) == 1
    assert same(1, 2, 3, 9) and same(20, 21, 22) and same(*range(100, 160)) and same(*range(200, 241)) and 5 not in got
    assert len(set(got.values())) == 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(clashing):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(clashing).collect()), key=str)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert len(got) == 11 and by[1][0] == by[1][1] and by[8] == by[1][:1]
    assert by[2] == by[3] == by[4] == [("0" * 16, 2)]
    assert sorted(by[None]) == sorted([by[1][0], ("0" * 16, 2)])
    assert S.near_duplicates(clashing.where("doc_id > 100")).count() == 0


def test_case_alone(docs_of):
    df = docs_of(["a b", "c d"]).withColumn("Text2", F.lit("x")).withColumnRenamed("Text2", "TEXT")
    assert S.near_duplicates(df).count() == 2
