import numpy as np

from tesselann.llm import copies as C


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of(rows):
    """Brute force: the smallest doc_id of each component under similarity 0.8."""
    own, up = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or both >= 0.8 * (len(own[i]) + len(own[j]) - both) - 1e-9:
                up[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(low.values())


def test_near_copies(spark, sample, docs_of, monkeypatch):
    """Copies with a few words changed, cut or added, beside the sample's own texts."""
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    base = [t.split() for _, t in rows if t and 40 < len(t.split()) < 400][:60]
    for w in base:
        for _ in range(3):
            x = list(w)
            for k in rng.choice(len(x), int(rng.integers(1, max(2, len(x) // 40))), replace=False):
                x[k] = f"new{rng.integers(10**9)}"
            rows.append((10**6 + len(rows), " ".join(x[int(rng.integers(0, 3)) :])))
    got = lambda: sorted(r.doc_id for r in C.one_of_each(docs_of(rows)).collect())
    want = kept_of(rows)
    assert got() == want
    monkeypatch.setattr(C, "CHUNK", 400)  # buckets of many chunks
    assert got() == want


def test_large_buckets(docs_of, monkeypatch):
    """A bucket whose leader is like few of the others: chains, pairs and single texts, over many chunks and blocks."""
    monkeypatch.setattr(C, "CHUNK", 150)
    monkeypatch.setattr(C, "bands", lambda s: np.zeros(1, np.int64) if len(s) else np.zeros(0, np.int64))
    base, rows = [f"w{i}" for i in range(60)], []
    for k in range(25):  # each is like the next, and unlike those after it
        rows.append((100 + k, " ".join([f"c{i}" for i in range(k)] + base[k:])))
    for k in range(20):
        own = [f"p{k}x{i}" for i in range(40)]
        rows += [(300 + 2 * k, " ".join(own)), (301 + 2 * k, " ".join([*own[:-1], "end"]))]
    rows += [(500 + k, " ".join(f"s{k}x{i}" for i in range(30))) for k in range(15)]
    assert sorted(r.doc_id for r in C.one_of_each(docs_of(rows)).collect()) == kept_of(rows)


def test_linked_sets():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(40, 200)))) for _ in range(int(rng.integers(2, 30)))]
        label = C.linked_sets(sets)
        up = list(range(len(sets)))
        find = lambda i: i if up[i] == i else find(up[i])
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
        assert label.tolist() == [find(i) for i in range(len(sets))]


def test_odd_rows(clashing, docs_of):
    kept = C.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 5, 6, 7]
    assert C.one_of_each(clashing.where("doc_id > 100")).count() == 0


def test_repeated_id(docs_of):
    """Different texts under one doc_id are no copies of each other."""
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (1, "a b c d e f g"), (2, "q r s t u v w")]
    assert sorted((r.doc_id, r.text) for r in C.one_of_each(docs_of(rows)).collect()) == [(1, "a b c d e f g"), (1, "q r s t u v w")]
