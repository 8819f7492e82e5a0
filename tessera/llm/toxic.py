"""Toxicity from a learned lexicon: Levenshtein automata intersected with the lexicon's trie, judged in context.

``learn`` takes labelled rows and keeps words and stems (beginnings of words) that toxic texts use in several different
contexts and others hardly ever use; counting contexts, not texts, keeps groups of copies from making words of their own.
A text's word is looked up in the trie; if it isn't there, the automaton of all words within one edit (or swapped
neighbours) of it is run along the trie's branches. Hits of such variants that untoxic labelled texts use are ignored.
The words around a hit tell quotation (inside quotation marks, or after a word of reporting) from abuse. Logistic
regression, with a prior for cases that the labels don't show, turns the counts into a score.

The fit uses at most about ``MOST_LABELLED`` labelled rows, the ones with the smallest hashes; scoring covers all.

Cases: null and empty texts get the score of texts without hits; labels without document, null labels and labels of
repeated ids are fine (each pair counts); without any labelled toxic row the lexicon is empty and all scores are equal and low.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACED, Words, as_bytes, chunks
from .shared import stage

MOST_LABELLED, LABELLED_TASKS = 20_000, 24
#: A word or stem needs so many different neighbours in toxic texts, and at most this share of the texts that use it untoxic.
LEAST_CONTEXTS, MOST_CLEAN = 5, 0.02
STEMS = range(5, 9)
SHORTEST_FUZZY = 5
WINDOW = 6
#: Words that a worker remembers the verdicts of.
CACHE_WORDS = 400_000
# Words of reporting and quotation marks, by pairs or alike at both ends.
REPORTING = set("said says say wrote writes called calls calling quote quoted quotes quoting term word words reported according dit écrit sagte schrieb nannte zitat dijo escribió llamó".split())
QUOTES = "\"“”„«»‘’"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Prior means of the weights: of abusive hits, fuzzy hits, quoted hits (each log(1 + count)), hits in a hundred words, and 1.
PRIOR = np.array([5.0, 3.6, 0.8, 0.3, -3.6])


class Automaton:
    """Levenshtein automata with swaps, in parametric form: transitions depend on a window of equalities only."""

    def __init__(self, edits: int = 1):
        self.edits, self.memo = edits, {}
        self.reach = 2 * edits + 2  # letters ahead that a step can ask for

    def start(self) -> frozenset:
        return frozenset([(0, 0, False)])

    def step(self, state: frozenset, base: int, word: str, char: str) -> tuple[frozenset, int]:
        """The state after a char of the trie, and its base: positions in the word count from there."""
        window = word[base : base + self.reach]
        key = (state, tuple(c == char for c in window))
        if key not in self.memo:
            same, out = key[1], set()
            for i, e, swap in state:
                if swap:
                    if i < len(same) and same[i]:
                        out.add((i + 2, e, False))
                    continue
                if i < len(same) and same[i]:
                    out.add((i + 1, e, False))
                if e < self.edits:
                    out.add((i, e + 1, False))
                    if i < len(same):
                        out.add((i + 1, e + 1, False))
                    for k in range(1, self.edits - e + 1):
                        if i + k < len(same) and same[i + k]:
                            out.add((i + k + 1, e + k, False))
                    if i + 1 < len(same) and same[i + 1]:
                        out.add((i, e + 1, True))
            low = min((i for i, _, _ in out), default=0)
            self.memo[key] = (frozenset((i - low, e, s) for i, e, s in out), low)
        after, low = self.memo[key]
        return after, base + low

    def accepts(self, state: frozenset, base: int, word: str) -> bool:
        return any(not s and len(word) - base - i + e <= self.edits and base + i <= len(word) for i, e, s in state)


class Trie:
    """Words and stems, with the automaton's way through them."""

    def __init__(self, words, stems=()):
        self.root: dict = {}
        #: By length of the lexicon's words: (letters at the head, at the tail, the words' heads, their tails).
        self.ends: dict[int, tuple[int, int, set, set]] = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            if len(w) >= SHORTEST_FUZZY:
                # One edit leaves so many of the first letters as they are, or so many of the last ones.
                n = len(w)
                head, tail, heads, tails = self.ends.setdefault(n, ((n - 1) // 2, n // 2, set(), set()))
                heads.add(w[:head])
                tails.add(w[-tail:])
        self.by_stem, self.words = set(stems), set(words)
        self.automaton = Automaton(1)

    def exact(self, word: str) -> bool:
        if word in self.words:
            return True
        for n in STEMS:
            if word[:n] in self.by_stem:
                return True
        return False

    def near(self, word: str) -> str | None:
        """A word of the trie within one edit, the first in order; or None."""
        n = len(word)
        for k in (n - 1, n, n + 1):
            if k in self.ends:
                head, tail, heads, tails = self.ends[k]
                if word[:head] in heads or word[-tail:] in tails:
                    break
        else:
            return None
        auto = self.automaton
        found, todo = None, [(self.root, auto.start(), 0)]
        while todo:
            node, state, base = todo.pop()
            for c, child in node.items():
                if c == "":
                    if len(child) >= SHORTEST_FUZZY and auto.accepts(state, base, word) and (found is None or child < found):
                        found = child
                    continue
                after, low = auto.step(state, base, word, c)
                if after:
                    todo.append((child, after, low))
        return found


def bare(word: str) -> str:
    """A word without what isn't a letter or digit at its ends."""
    word = word.strip(MARKS)
    return EDGE.sub("", word) if word and not (word[0].isalnum() and word[-1].isalnum()) else word


@dataclass
class Model:
    words: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    clean: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds the hits of texts; one a task, with a memory of words (by their hashes)."""

    def __init__(self, model: Model):
        self.trie, self.clean, self.weights, self.any = Trie(model.words, model.stems), model.clean, model.weights, bool(model.words or model.stems)
        self.seen: dict[int, int] = {}

    def code(self, raw: str) -> int:
        """1: a word of the lexicon, 2: a variant of one, 0: neither; of a word with A-Z in lower case."""
        found = 0
        for part in (raw,) if raw.isascii() else raw.lower().split():  # letters and white space beyond ASCII
            w = bare(part)
            if w and self.trie.exact(w):
                return 1
            if w and w not in self.clean and self.trie.near(w):
                found = 2
        return found

    def hits(self, texts: list[bytes]):
        """(first text, Words, places of the hits, kinds of these, text of each) of runs of texts; each distinct word of a run is looked up once."""
        for a, b in chunks(texts):
            words = Words(texts[a:b], SPACED)
            own, first, of = np.unique(words.hashes() if self.any else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            seen, codes = self.seen, np.zeros(len(own), np.int8)
            for k, h in enumerate(own.tolist()):
                code = seen.get(h)
                if code is None:
                    code = seen[h] = self.code(words.word(int(first[k])).decode(errors="replace"))
                if code:
                    codes[k] = code
            at = np.flatnonzero(codes[of]) if self.any else np.zeros(0, np.int64)
            yield a, words, at, codes[of[at]], np.searchsorted(words.first, at, side="right") - 1

    @staticmethod
    def quoted(words: list[str], at: int) -> bool:
        """Whether a hit stands between quotation marks within the window, or after a word of reporting with a mark."""
        w = words[at]
        before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        opens = any(x[:1] and x[0] in QUOTES for x in (*before, w))
        closes = any(x.rstrip(".,;:!?)")[-1:] and x.rstrip(".,;:!?)")[-1] in QUOTES for x in (w, *after))
        return opens and closes or any(bare(x) in REPORTING for x in before[-3:]) and (opens or closes)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: its abusive, fuzzy and quoted hits, each as log(1 + count), the hits in a hundred words, and 1."""
        count, n = np.zeros((len(texts), 3)), np.zeros(len(texts))
        for a, words, at, kinds, of in self.hits(texts):
            n[a : a + len(words.first) - 1] = np.diff(words.first)
            for i, kind, k in zip(at.tolist(), kinds.tolist(), of.tolist(), strict=True):
                begin, end = max(int(words.first[k]), i - WINDOW), min(int(words.first[k + 1]), i + 1 + WINDOW)
                near = [words.word(j).decode(errors="replace").lower() for j in range(begin, end)]
                count[a + k, 2 if self.quoted(near, i - begin) else kind - 1] += 1
        rate = np.minimum(10.0, 100.0 * (count[:, 0] + 0.5 * count[:, 1]) / np.maximum(1, n))
        return np.column_stack([np.log1p(count), rate, np.ones(len(texts))])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return score(self.features(texts), self.weights)


def score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 3.0) -> np.ndarray:
    """Logistic regression with a normal prior around PRIOR, by Newton's method; weights of hits don't fall below 0."""
    w = PRIOR.copy()
    ridge = np.diag([strength, strength, strength, strength, 0.05])
    for _ in range(25):
        p = score(x, w)
        g = x.T @ (p - y) + ridge @ (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w[:4] = np.maximum(w[:4], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column, of: int = 5, rest: int = 0) -> Column:
    return F.crc32(doc_id.cast("string")) % of == rest


def _keys(words: list[str]):
    """(key, neighbour) of each word and its stems; stems end in a mark."""
    last = ""
    for raw in words:
        w = bare(raw)
        if len(w) >= 4 and w.isalpha():
            yield w, last
            for n in STEMS:
                if len(w) > n:
                    yield w[:n] + "*", last
        last = w


def _contexts(batches):
    """Of toxic texts: for each key the texts that have it, and a 64-bit set of hashed neighbours."""
    import zlib

    found: dict[str, list[int]] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            here: dict[str, int] = {}
            for key, last in _keys((text or "").lower().split()):
                here[key] = here.get(key, 0) | 1 << (zlib.crc32(last.encode()) & 63)
            for key, bits in here.items():
                kept = found.setdefault(key, [0, 0])
                kept[0] += 1
                kept[1] |= bits
    items = list(found.items())
    for a in range(0, len(items), 50_000):
        part = items[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v[0] for _, v in part], pa.int64()), pa.array(np.array([v[1] for _, v in part], np.uint64).view(np.int64))], names=["key", "n", "bits"])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model of the labelled rows (doc_id, toxic) given; callers leave held-out rows out."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    # The broadcast rows are bounded by ``most``.
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).select("text", "toxic")
    rows = stage(labelled.repartition(LABELLED_TASKS), "labelled")
    toxic = rows.where("toxic = 1").select("text").mapInArrow(_contexts, "key string, n long, bits long").groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
    candidates = {r["key"]: r["n"] for r in toxic.where(F.bit_count("bits") >= LEAST_CONTEXTS).select("key", "n").toLocalIterator()}

    def clean(batches):
        class Keys(dict):
            def __missing__(self, raw: str) -> frozenset:
                got = self[raw] = frozenset(k for k, _ in _keys([raw]) if k in candidates)
                return got

        keys, count = Keys(), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for key in frozenset().union(*map(keys.__getitem__, set((text or "").lower().split()))):
                    count[key] = count.get(key, 0) + 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["key", "n"])

    untoxic = rows.where("toxic <> 1").select("text")
    often = {r["key"]: r["n"] for r in untoxic.mapInArrow(clean, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator()}
    kept = {k for k, n in candidates.items() if often.get(k, 0) <= MOST_CLEAN * (often.get(k, 0) + n)}
    stems = {k[:-1] for k in kept if k.endswith("*")}
    stems = {s for s in stems if not any(s[:n] in stems for n in range(STEMS.start, len(s)))}
    model = Model({k for k in kept if not k.endswith("*")}, stems)

    def variants(batches):
        matcher, found = model.matcher(), set()
        for batch in batches:
            for _, words, at, kinds, _ in matcher.hits(as_bytes(batch.column(0))):
                found |= {bare(part) for raw in {words.word(i) for i in at[kinds == 2].tolist()} for part in raw.decode(errors="replace").lower().split()}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found))], names=["word"])

    model.clean = {r["word"] for r in untoxic.mapInArrow(variants, "word string").distinct().toLocalIterator()}

    def features(batches):
        matcher = model.matcher()
        for batch in batches:
            x = matcher.features(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*"abcde", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(features, "a double, b double, c double, d double, e double, toxic int").groupBy("a", "b", "c", "d", "e").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y"), F.count("*").alias("n")).collect()
    if any(r["y"] for r in got):
        x = np.array([[*r[:5]] for r in got for _ in (0, 1)])
        times = np.array([r["n"] - r["y"] if y == 0 else r["y"] for r in got for y in (0, 1)], np.int64)
        y = np.tile([0.0, 1.0], len(got))
        model.weights = fit(np.repeat(x, times, axis=0), np.repeat(y, times))
    return model


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row."""

    def work(batches):
        matcher = model.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matcher.scores(as_bytes(batch.column(1))))], names=["doc_id", "score"])

    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def untoxic_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs (doc_id and text among the columns) that score below 0.5; each text goes to Python once."""
    model, at = learn(docs, labels), docs.columns.index(text)

    def work(batches):
        matcher = model.matcher()
        for batch in batches:
            yield batch.filter(pa.array(matcher.scores(as_bytes(batch.column(at))) < 0.5))

    return docs.mapInArrow(work, docs.schema)
