"""The learned operators: held-out accuracy, normalised probabilities, exact counts; and the pipeline as a whole."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import logbilinear as lm
from tessera.llm import toxic
from tessera.llm.queries import QUERIES

LEXICON = {"idiot", "moron", "worthless", "pathetic", "scum"}


@pytest.mark.parametrize("word,near", [("idiot", None), ("idiit", "idiot"), ("idot", "idiot"), ("idioot", "idiot"), ("diiot", "idiot"), ("idito", "idiot"), ("odoit", None), ("scum", None), ("scom", None), ("worthles", "worthless"), ("pathteic", "pathetic")])
def test_automaton(word, near):
    t = toxic.Trie(LEXICON)
    assert t.exact(word) == (word in LEXICON)
    if word not in LEXICON:
        assert t.near(word) == near


def test_automaton_against_distance():
    rng = np.random.default_rng(0)

    def distance(a, b):
        d = {(i, j): i + j for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1) if i * j == 0 or i < 0 or j < 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    say = lambda n: "".join(rng.choice(list("abc"), n))
    words = {say(rng.integers(5, 8)) for _ in range(30)}
    t = toxic.Trie(words)
    for _ in range(400):
        w = say(rng.integers(4, 9))
        want = sorted(x for x in words if distance(w, x) <= 1)
        assert t.near(w) == (want[0] if want else None), (w, want)


def test_quotation():
    m = toxic.Model(LEXICON).matcher()
    low = lambda t: m.scores([t.encode()])[0]
    assert low('they wrote "what an idiot" in the paper') < 0.5 < low("you are an idiot") and low("nothing here") < 0.1 and low("you idiit and moorn") > 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op8_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hit[1, 1] >= 0.85 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1])


def test_toxic_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (None, 1), (0, 0), (5, None), (4, 0)], "doc_id long, toxic int")
    model = toxic.learn(odd, labels)
    out = toxic.score_texts(odd, model)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxic.score_texts(none, toxic.learn(none, labels)).count() == 0
    assert toxic.untoxic_documents(odd, labels.where("false")).columns == odd.columns


def test_lm_counts_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs}
    aside = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(w for i, t in tokens.items() if i not in aside for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op9_lm_score"](spark, sf).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in aside, len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_gain_grows(spark):
    """On more text than the smallest table has, a clear gain for each held-out token."""
    held = QUERIES["op9_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.2 * held[2]


def test_lm_is_normalised():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    form_words, form_tokens = np.zeros(lm.FORMS, np.int64), np.zeros(lm.FORMS, np.int64)
    counts, forms = np.arange(1, 41), rng.integers(0, 3, 40)
    for c, f in zip(counts, forms, strict=True):
        form_words[f] += 1
        form_tokens[f] += c
    form_words[1] += 2
    form_tokens[1] += 5  # two rare words
    classes = lm.Classes(h, counts, forms, form_words, form_tokens, 42, int(form_tokens.sum()))
    model = lm.Model(classes)
    w = rng.integers(0, classes.size, 5000)
    one, two = lm._contexts(classes.context[w], np.array([2000, 3000]), classes.contexts)
    model.train(one, two, w, rng, [np.zeros_like(p) for p in model.parts()])
    z, every = model.normalisers(), np.arange(classes.size)
    for x, y in ((0, 1), (3, classes.contexts), (classes.contexts, classes.contexts)):
        p = np.exp(model.log_scores(np.full(classes.size, x), np.full(classes.size, y), every, z))
        assert p.sum() == pytest.approx(1.0, abs=1e-4)
    share = classes.share(np.array([classes.n + 1] * 3), np.array([2, 3, 0]))
    assert (10**share).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("run,scored", [(7, 5), (1000, 1000)])
def test_lm_runs_of_classes(monkeypatch, run, scored):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    rng = np.random.default_rng(2)
    n, none = 30, np.zeros(lm.FORMS, np.int64)
    classes = lm.Classes(rng.integers(0, 1 << 63, n).astype(np.uint64), np.arange(n, 0, -1), np.full(n, 9), none + 60, none + 500, 99, 999)
    assert (classes.size, classes.contexts) == (n + lm.FORMS, 4 + lm.FORMS)
    at = classes.of(classes.hashes, np.full(n, 9))
    assert sorted(classes.context[at].tolist()) == [0, 1, 2, 3] + [4 + 9] * (n - 4)  # the four most frequent words, and the others' form
    model, plain = lm.Model(classes), None
    monkeypatch.setattr(lm, "RUN", run)
    monkeypatch.setattr(lm, "SCORED", scored)
    z = model.normalisers()
    plain = np.log(np.exp((model.c1[5] + model.c2[8]).astype(float) @ model.r.T + model.b).sum())
    assert z[5, 8] == pytest.approx(plain, abs=1e-4)
    w = np.arange(23)
    assert model.log_scores(w % 3, w % 5, w, z) == pytest.approx([float((model.c1[x % 3] + model.c2[x % 5]) @ model.r[x] + model.b[x] - z[x % 3, x % 5]) for x in w], abs=1e-4)


def test_lm_most_frequent():
    end = lm.END.view(np.int64)
    h, c = np.array([5, end, 3, -2]), np.array([9, 1, 9, 20])
    got = lm._most_frequent(h, c, np.arange(4), 3)
    assert got[0].tolist() == [end, -2, 3] and got[2].tolist() == [1, 3, 2]


def test_lm_odd(odd, none):
    scores, classes = lm.score_corpus(odd, F.col("doc_id") % 2 == 0)
    rows = scores.collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in rows) and classes.tokens > 60_000
    assert lm.score_corpus(none, F.lit(True))[0].count() == 0
    assert all(math.isfinite(r["score"]) for r in lm.score_corpus(odd, F.lit(False))[0].collect())


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    start = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, d)
        assert out.columns == start.columns and 0 < out.count()
        before = Counter(r["doc_id"] for r in docs.collect())
        after = Counter(r["doc_id"] for r in out.collect())
        assert set(after) <= set(before), name
        if name != "mixing":
            assert not after - before
        docs = corpus_pipeline.stage(out, name)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_pipeline_odd(spark, odd, none, tmp_path):
    spark.createDataFrame([(4, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w0 w1 w2 w3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (none, odd):
        for name, step in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("kind", ["<u4", "<i8"])
def test_lm_planes(kind):
    for numbers in ([], [0], [1, 70_000, 255, 256, 2**31]):
        assert lm._from_planes(lm._planes(np.array(numbers, np.int64), kind), kind).tolist() == numbers
