"""Language-model scores: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words and one end for each text. The frequent words are classes of their own, as many as GROWTH times the square
root of the training tokens (a corpus's words grow about like that), so what is learned grows with the input; other words
share a class with words of the same last bytes. The most frequent classes are contexts, the others are told by their last
bytes there. The two contexts before a token give a vector C1[a] + C2[b]; a class's score is its product with R[w], plus
a bias. Training makes classes of the corpus stand out from drawn noise, on each task's share of all
training tokens; the tasks' parameters are averaged and trained on (a first round, over a hashed share of the blocks, gives
all tasks the same start). Because the context is a sum, the sum over all classes for every two before is a matrix product,
exp(C1 R' + b) exp(C2 R')', taken over runs of classes, so probabilities are exactly normalised. A rare word's is its class's times its share there,
(count + 1/2) in all counts of the class + 1/2 for each of its words and an unseen one.

Counts cover the whole corpus: each block of texts has a dictionary of the hashes (64 bits) of its words, with their counts;
slices of the dictionaries meet by hash, and totals go back to the blocks. So the shuffle carries each word once a block, and
no word, however frequent, makes a task large.

Cases: null and empty texts have the end only; rows of equal or null ids each get their row; without training tokens
all words are unseen; no rows give none; long texts are blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACED, Words, as_bytes, chunks, mix64
from .shared import partitions, stage

#: Words that are contexts of their own (and the least number with a class each), classes of the others by form, the width
#: of vectors, and words with a class each for the square root of the training tokens.
FREQUENT, FORMS, WIDTH, GROWTH = 1024, 512, 16, 2.0
#: Classes whose scores are summed at once, and tokens scored at once.
RUN, SCORED = 4096, 1 << 16
BATCH, NOISE, RATE, WARM_SHARE = 1024, 128, 0.08, 8
#: Bytes of text of a block, and those that are hashed at once.
BLOCK, HASH_RUN = 4 << 20, (1 << 19) - (1 << 14)
END = np.uint64(0x5E17AB1E0DD5EED5)
BLOCKS = "kind int, block long, ids array<long>, train array<boolean>, lengths array<int>, tokens binary, hashes binary, forms binary, bucket int, slice binary, counts binary, slice_forms binary"
_BLOCKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("tokens", "hashes", "forms")), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("slice", "counts", "slice_forms"))])


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers with all their lowest bytes first, then the next, and so on: small numbers compress well so."""
    return np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, len(data) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _tokens(texts: list[bytes]):
    """Hashes and forms of all tokens, an end after each text, and the texts' lengths in tokens."""
    words = Words(texts, SPACED)
    h, d, last = words.hashes(), words.data.astype(np.int64), words.end - 1
    form = (mix64((d[last] << 16 | d[np.maximum(last - 1, words.start)] << 8 | d[np.maximum(last - 2, words.start)]).astype(np.uint64)) % np.uint64(FORMS)).astype(np.uint16)
    first = words.first[: len(texts) + 1]
    lengths = np.diff(first) + 1
    at = np.arange(len(h)) + np.repeat(np.arange(len(texts)), lengths - 1)
    hashes, forms = np.full(len(h) + len(texts), END), np.zeros(len(h) + len(texts), np.uint16)
    hashes[at], forms[at] = h, form
    return hashes, forms, lengths


def _tokens_of_block(texts: list[bytes]):
    """As _tokens, with the bytes hashed in smaller runs: a worker's tables of powers stay small."""
    parts = [_tokens(texts[a:b]) for a, b in chunks(texts, HASH_RUN)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _blocks(batches, buckets: int):
    from pyspark import TaskContext

    task, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, ids, train = as_bytes(batch.column(2)), batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in chunks(texts, BLOCK):
            hashes, forms, lengths = _tokens_of_block(texts[a:b])
            own, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
            learnt = np.repeat(np.array(train[a:b], bool), lengths)
            # Words are numbered by how often they come in the block: most numbers are small.
            order = np.argsort(-np.bincount(tokens, minlength=len(own)), kind="stable")
            own, first, tokens = own[order], first[order], np.argsort(order)[tokens]
            counts = np.bincount(tokens[learnt], minlength=len(own))
            block, nth = task << 24 | nth, nth + 1
            own_forms = forms[first]
            rows = [(0, block, ids[a:b], train[a:b], lengths, _planes(tokens, "<u4"), own.tobytes(), own_forms.tobytes(), None, None, None, None)]
            slot = (own % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            ends = np.searchsorted(slot[order], np.arange(buckets + 1))
            for k in np.unique(slot).tolist():
                at = order[ends[k] : ends[k + 1]]
                rows.append((1, block, None, None, None, None, None, None, k, own[at].tobytes(), _planes(counts[at], "<u4"), own_forms[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


TOTALS = "kind int, block long, bucket int, totals binary, words long, tokens long, form_words array<long>, form_tokens array<long>, top_hash array<long>, top_count array<long>, top_form array<int>"
_TOTALS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("form_words", pa.list_(pa.int64())), ("form_tokens", pa.list_(pa.int64())), ("top_hash", pa.list_(pa.int64())), ("top_count", pa.list_(pa.int64())), ("top_form", pa.list_(pa.int32()))])


def _most_frequent(h: np.ndarray, c: np.ndarray, f: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` most frequent words, the end before all others; ties to smaller hashes."""
    at = np.lexsort((h, -c, h != int(END.view(np.int64))))[:wanted]
    return h[at], c[at], f[at]


def _totals(key, table, wanted: int):
    """A slice's totals over all blocks, for each block in its own order; and a row of sums."""
    slices = [np.frombuffer(x, np.uint64) for x in table.column("slice").to_pylist()]
    h = np.concatenate(slices)
    counts = np.concatenate([_from_planes(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
    forms = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("slice_forms").to_pylist()])
    own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(own)).astype(np.int64)
    back = np.split(total[inverse], np.cumsum([len(s) for s in slices])[:-1])
    known, form = total > 0, forms[first]
    seen = own[known].view(np.int64)
    top = _most_frequent(seen, total[known], form[known].astype(np.int32), wanted)
    rows = [(1, b, k, _planes(x, "<i8"), None, None, None, None, None, None, None) for b, k, x in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), back, strict=True)]
    rows.append((0, None, None, None, int(known.sum()), int(total.sum()), np.bincount(form[known], minlength=FORMS), np.bincount(form, weights=total, minlength=FORMS).astype(np.int64), *top))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOTALS, strict=True)], schema=_TOTALS)


MERGED = "form_words array<long>, form_tokens array<long>, top_hash array<long>, top_count array<long>, top_form array<int>"


def _merge_sums(batches, wanted: int):
    """A task's rows of sums as one: added up, and the most frequent words of all (the end among them)."""
    words, tokens, seen = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64), False
    top = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
    for batch in batches:
        for w, t, *more in zip(*batch.columns, strict=True):
            words, tokens, seen = words + w.values.to_numpy(), tokens + t.values.to_numpy(), True
            top = _most_frequent(*(np.concatenate([x, y.values.to_numpy()]) for x, y in zip(top, more, strict=True)), wanted)
    if seen:
        lists = [pa.array([x], f.type) for x, f in zip((words, tokens, *top), (_TOTALS.field(k) for k in range(6, 11)), strict=True)]
        yield pa.RecordBatch.from_arrays(lists, names=["form_words", "form_tokens", "top_hash", "top_count", "top_form"])


class Classes:
    """What class each word has, the context of each class, and the shares of words in classes of forms. Words come by rank."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, forms: np.ndarray, form_words: np.ndarray, form_tokens: np.ndarray, words: int, tokens: int):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], len(hashes)
        self.words, self.tokens = words, tokens
        seen = counts > 0
        self.form_words = form_words - np.bincount(forms[seen], minlength=FORMS)
        self.form_tokens = form_tokens - np.bincount(forms, weights=counts, minlength=FORMS)
        mass = np.concatenate([counts[order], self.form_tokens]).astype(np.float64) + 0.5
        self.prior = mass / mass.sum()
        self.size = self.n + FORMS
        # The context of a class: a word's rank if that is high, or else its form, as for the classes of forms. The last context stands before a text.
        own = min(self.n, FREQUENT)
        self.context = np.concatenate([np.where(order < own, order, own + forms[order]), own + np.arange(FORMS)]).astype(np.int64)
        self.contexts = own + FORMS

    def of(self, hashes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        return np.where(self.hashes[at] == hashes, at, self.n + forms.astype(np.int64))

    def share(self, classes: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """log10 of each word's share in its class."""
        form = np.maximum(classes - self.n, 0)
        rare = np.log10((totals + 0.5) / (self.form_tokens[form] + 0.5 * (self.form_words[form] + 1)))
        return np.where(classes < self.n, 0.0, rare)


class Model:
    """C1, C2 (a context of its own, the last, stands before a text), R and b."""

    def __init__(self, classes: Classes, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.prior = classes.prior
        self.c1, self.c2, self.r = (rng.normal(0, 0.1, (m, WIDTH)).astype(np.float32) for m in (classes.contexts + 1, classes.contexts + 1, classes.size))
        self.b = np.log(classes.prior).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.c1, self.c2, self.r, self.b]

    def train(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, rng, past: list[np.ndarray]) -> None:
        """Noise-contrastive steps over tokens w with the contexts one and two places before; ``past``: squared gradients so far."""
        offset, upto = np.log(NOISE * self.prior).astype(np.float32), np.cumsum(self.prior)
        for a in range(0, len(w), BATCH):
            x, y, z = one[a : a + BATCH], two[a : a + BATCH], w[a : a + BATCH]
            noise = np.minimum(np.searchsorted(upto, rng.random(NOISE) * upto[-1], side="right"), len(upto) - 1)
            q = self.c1[x] + self.c2[y]
            rz, rn = self.r[z], self.r[noise]
            up = _sigmoid(offset[z] - self.b[z] - np.einsum("ij,ij->i", q, rz))  # 1 - sigmoid of the score
            down = -_sigmoid(q @ rn.T + (self.b[noise] - offset[noise]))
            dq = up[:, None] * rz + down @ rn
            hit, at = np.unique(np.concatenate([z, noise]), return_inverse=True)  # of the classes only those that occur here change
            dr, db = _sums(at[: len(z)], up[:, None] * q, len(hit)), np.bincount(at[: len(z)], weights=up, minlength=len(hit)).astype(np.float32)
            np.add.at(dr, at[len(z) :], down.T @ q)
            np.add.at(db, at[len(z) :], down.sum(axis=0))
            for p, g, s in zip(self.parts()[:2], (_sums(x, dq, len(self.c1)), _sums(y, dq, len(self.c2))), past[:2], strict=True):
                s += g * g
                p += RATE * g / np.sqrt(s + 1.0)
            for p, g, s in zip(self.parts()[2:], (dr, db), past[2:], strict=True):
                s[hit] += g * g
                p[hit] += RATE * g / np.sqrt(s[hit] + 1.0)

    def normalisers(self) -> np.ndarray:
        """The log of the sum of all classes' scores, by the context before and the one before that."""
        runs = range(0, len(self.r), RUN)
        scores = lambda c, k: c @ self.r[k : k + RUN].T
        ma = np.max([(scores(self.c1, k) + self.b[k : k + RUN]).max(axis=1) for k in runs], axis=0)[:, None]
        mb = np.max([scores(self.c2, k).max(axis=1) for k in runs], axis=0)[:, None]
        total = np.zeros((len(self.c1), len(self.c2)))
        for k in runs:
            total += np.exp(scores(self.c1, k) + self.b[k : k + RUN] - ma).astype(np.float64) @ np.exp(scores(self.c2, k) - mb).astype(np.float64).T
        return (np.log(total) + ma + mb.T).astype(np.float32)

    def log_scores(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The log probabilities of classes w after these contexts."""
        out = np.empty(len(w))
        for a in range(0, len(w), SCORED):
            s = slice(a, a + SCORED)
            out[s] = np.einsum("ij,ij->i", self.c1[one[s]] + self.c2[two[s]], self.r[w[s]]) + self.b[w[s]] - z[one[s], two[s]]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30), dtype=np.float32))


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each place."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.diff(s, prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(first):
        out[s[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _contexts(contexts: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts one and two places before each token; ``start`` stands before a text."""
    begin = np.cumsum(lengths) - lengths
    one = np.concatenate([[start], contexts[:-1]])
    one[begin] = start
    two = np.concatenate([[start], one[:-1]])
    two[begin] = start
    return one, two


def _train_task(batches, classes: Classes, model: Model):
    """The parameters after a task's blocks, with the number of tokens they have seen."""
    rng, seen = np.random.default_rng(11), 0
    past = [np.zeros_like(p) for p in model.parts()]
    mine = [p.copy() for p in model.parts()]
    local = Model.__new__(Model)
    local.prior = model.prior
    local.c1, local.c2, local.r, local.b = mine
    for batch in batches:
        for train, lengths, tokens, hashes, forms in zip(*(batch.column(k) for k in range(5)), strict=True):
            lengths, train = np.array(lengths.as_py(), np.int64), np.array(train.as_py(), bool)
            of = classes.of(np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(forms.as_py(), np.uint16))[_from_planes(tokens.as_py(), "<u4")]
            one, two = _contexts(classes.context[of], lengths, classes.contexts)
            use = np.repeat(train, lengths)
            local.train(one[use], two[use], of[use], rng, past)
            seen += int(use.sum())
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in mine)], names=["seen", "c1", "c2", "r", "b"])


def _mean(seen: list[int], parts: list[bytes]) -> np.ndarray:
    """The mean of parameters, each by the tokens it has seen."""
    return (sum(np.frombuffer(x, np.float32).astype(np.float64) * n for n, x in zip(seen, parts, strict=True)) / sum(seen)).astype(np.float32)


def _add_up(key, table):
    seen = table.column("seen").to_pylist()
    means = [_mean(seen, table.column(c).to_pylist()).tobytes() for c in ("c1", "c2", "r", "b")]
    return pa.table([pa.array([sum(seen)], pa.int64()), *(pa.array([s], pa.binary()) for s in means)], names=["seen", "c1", "c2", "r", "b"])


def _round(blocks: DataFrame, classes: Classes, model: Model) -> None:
    """One pass of training; the mean of the tasks' parameters, by tokens, becomes the model's."""
    kind = "seen long, c1 binary, c2 binary, r binary, b binary"
    parts = blocks.select("train", "lengths", "tokens", "hashes", "forms").mapInArrow(lambda it: _train_task(it, classes, model), kind)
    # Summed in two steps: the driver gets 8 rows of parameters, whatever the number of tasks.
    some = parts.groupBy(F.spark_partition_id().alias("k") % 64).applyInArrow(_add_up, kind)
    rows = some.groupBy(F.spark_partition_id() % 8).applyInArrow(_add_up, kind).collect()
    if rows:
        for name, p in zip(("c1", "c2", "r", "b"), model.parts(), strict=True):
            p[...] = _mean([r["seen"] for r in rows], [r[name] for r in rows]).reshape(p.shape)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score_block(key, left: pa.Table, right: pa.Table, classes: Classes, model: Model, z: np.ndarray) -> pa.Table:
    slot = {k: _from_planes(x, "<i8") for k, x in zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True)}
    out = []
    for ids, lengths, tokens, hashes, forms, buckets in zip(*(left.column(c).to_pylist() for c in ("ids", "lengths", "tokens", "hashes", "forms", "buckets")), strict=True):
        own, forms, tokens, lengths = np.frombuffer(hashes, np.uint64), np.frombuffer(forms, np.uint16), _from_planes(tokens, "<u4"), np.array(lengths, np.int64)
        total = np.empty(len(own), np.int64)
        total[np.argsort((own % np.uint64(buckets)).astype(np.int64), kind="stable")] = np.concatenate([slot[k] for k in sorted(slot)])
        of = classes.of(own, forms)
        share, base = classes.share(of, total), np.log10((total + 0.5) / (classes.tokens + 0.5 * (classes.words + 1)))
        w = of[tokens]
        one, two = _contexts(classes.context[w], lengths, classes.contexts)
        log10 = model.log_scores(one, two, w, z) / np.log(10.0) + share[tokens]
        begin = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, begin) for x in ((total > 0)[tokens].astype(np.int64), base[tokens], log10)]
        out.append(pa.table([pa.array(ids, pa.int64()), pa.array(lengths), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]))
    return pa.concat_tables(out)


def score_corpus(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Classes]:
    """The scores of each document by the model of those where ``train`` is true; and the classes, which hold the corpus counts."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    rows = stage(docs.select(F.col(doc_id).cast("long"), F.coalesce(train, F.lit(False)), text).mapInArrow(lambda it: _blocks(it, buckets), BLOCKS), "lm-blocks")
    blocks = rows.where("kind = 0").select("block", "ids", "train", "lengths", "tokens", "hashes", "forms")
    learnt = F.aggregate(F.zip_with("train", "lengths", lambda t, n: F.when(t, n).otherwise(0)), F.lit(0).cast("long"), lambda x, n: x + n)
    wanted = max(FREQUENT, int(GROWTH * (blocks.select(F.sum(learnt)).first()[0] or 0) ** 0.5))
    totals = stage(rows.where("kind = 1").select("block", "bucket", "slice", "counts", "slice_forms").groupBy("bucket").applyInArrow(lambda key, t: _totals(key, t, wanted), TOTALS), "lm-totals")
    sums = totals.where("kind = 0")
    n = sums.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    end, kept = END.view(np.int64), [_TOTALS.field(k).name for k in range(6, 11)]
    # At most 8 rows, of no more words than get a class each.
    some = sums.select(*kept).repartition(8).mapInArrow(lambda it: _merge_sums(it, wanted), MERGED).toArrow()
    form_words, form_tokens = (sum((x.values.to_numpy() for x in some.column(c)), np.zeros(FORMS, np.int64)) for c in ("form_words", "form_tokens"))
    top = [np.concatenate([x.values.to_numpy() for x in some.column(c)] or [np.zeros(0, np.int64)]) for c in ("top_hash", "top_count", "top_form")]
    top = _most_frequent(*top, wanted)
    if not len(top[0]) or top[0][0] != end:
        top = [np.concatenate([[x], y[: wanted - 1]]) for x, y in zip((end, 0, 0), top, strict=True)]
    classes = Classes(top[0].view(np.uint64), top[1], top[2].astype(np.int64), form_words, form_tokens, n["words"] or 0, n["tokens"] or 0)
    model = Model(classes)
    if classes.tokens:
        # A share of the blocks, drawn by a hash of their numbers, is the first round.
        _round(blocks.where(F.pmod(F.xxhash64("block"), F.lit(WARM_SHARE)) == 0), classes, model)
        _round(blocks, classes, model)
    shared = spark.sparkContext.broadcast((classes, model, model.normalisers()))
    left = blocks.withColumn("buckets", F.lit(buckets)).groupBy("block")
    right = totals.where("kind = 1").select(F.col("block").alias("of"), "bucket", "totals").groupBy("of")
    return left.cogroup(right).applyInArrow(lambda key, x, y: _score_block(key, x, y, *shared.value), SCORES), classes
