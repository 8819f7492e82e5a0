import numpy as np
import pytest

from tessera.llm import mtree


def brute(rows, k=5, every=50):
    good = [(n, i, np.floor(256 * np.array(v, float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, i, q in good:
        if i % every == 0:
            best = sorted((-int(q @ w), j) for m, j, w in good if m != n and len(w) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tree_rows,leaf", [(4096, 256), (50, 8)])
def test_against_brute_force(spark, monkeypatch, tree_rows, leaf):
    monkeypatch.setattr(mtree, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(250, 6)), np.repeat(rng.normal(size=(1, 6)), 120, 0), np.zeros((3, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [1.0, 2.0]), (1051, [float("nan")] * 6), (1052, [float("inf")] * 6), (None, [1.0] * 6), (50, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "2 as score", "3 as v")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df).collect())
    assert got == brute(rows)
    assert mtree.top_k(df.where("false")).count() == 0


def test_tree_search():
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, (2000, 4))
    v[500:900] = v[500]
    t = mtree.Tree(v, float((v**2).sum(axis=1).max()))
    ids = rng.permutation(2000)
    for q in range(0, 2000, 97):
        want = sorted((-int(v[q] @ v[j]), int(ids[j])) for j in range(2000) if j != q)[:5]
        assert [(-s, i) for s, i in t.search(v[q], 5, ids, q, np.arange(2000))] == want


def test_large_integers_stay_exact():
    v = np.array([[2**31, 1], [2**31, 2], [2**31 - 1, 3]], np.int64)
    got = mtree.Tree(v, float((v.astype(float) ** 2).sum(axis=1).max())).search(v[0], 2, np.arange(3), 0, np.arange(3))
    assert got == [(2**62 + 2, 1), (2**31 * (2**31 - 1) + 3, 2)]
