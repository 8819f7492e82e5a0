import random

import numpy as np

import corpus_pipeline
from tessera.llm import minhash


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    x, y = _shingles(a), _shingles(b)
    return x == y or len(x & y) >= 0.8 * len(x | y)


def _texts(copies=12):
    """Invented texts, near copies of them at many similarities around 0.8, exact copies, short and empty ones."""
    rng, out = random.Random(3), []
    for _ in range(copies):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(words))
        for changes in (0, 1, 2, 3, 4, 6, 9):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(len(near))] = f"x{rng.randrange(500)}"
            out.append(" ".join(near).upper() if changes == 0 else " ".join(near))
    return [*out, None, "", " \n", "three short words", "Three  short words", "three short wordz"]


def _brute(texts):
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and _alike(texts[i], texts[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_near_dedup_stage_is_whole(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(_brute(texts)))


def test_large_keys_lose_nothing(spark):
    texts = _texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = _brute(texts)
    roots = {r["k"]: r["root"] for r in minhash.near_copies(docs, most_nodes=1).collect()}
    assert len({(roots[k], want[k]) for k in roots}) == len(set(want)) == len(set(roots.values()))


def test_alike_texts_share_a_key():
    rng = np.random.default_rng(5)
    met, far, met_again, far_again = 0, 0, 0, 0
    for _ in range(3000):
        h = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = h[:162], np.concatenate([h[:144], h[162:]])  # 144 of 180 shingles: 0.8
        met += bool((minhash.keys_of(a) == minhash.keys_of(b)).any())
        c = np.concatenate([h[:81], rng.integers(0, 1 << 63, 41).astype(np.uint64)])  # 81 of 203: 0.4
        far += bool((minhash.keys_of(a) == minhash.keys_of(c)).any())
        long = minhash.keys_of(a, minhash.LONG)
        met_again += bool((long == minhash.keys_of(b, minhash.LONG)).any())
        far_again += bool((long == minhash.keys_of(c, minhash.LONG)).any())
    assert met >= 2999 and far <= 300
    assert met_again >= 2997 and far_again <= 30
