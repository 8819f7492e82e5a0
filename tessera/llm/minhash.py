"""Near copies by the Jaccard similarity of their five-word shingles: 0.8 or more, told exactly.

Candidates meet in two ways. First by SimHash: fingerprints of the shingles that a pigeonring finds within 3 bits. But
at 0.8 two texts differ in 4 to 14 of 64 bits (sf0.1), and within 14 bits all documents have chance neighbours, more of them the
more documents there are. So those farther apart meet by min-hashes: of 128 orders of all shingles a text's first in
each; 96 keys are made of eight of these firsts each, chosen once at random. Two texts of similarity s share a key with a
probability of s**8: at 0.8 one in six, so one of 96 but for less than one pair in 1,000 (the test counts it), at 0.5 one in
256, so texts that only have a passage in common seldom meet. Every candidate is then compared shingle by shingle (64-bit hashes).

Texts of the same words are one node. A key with up to 32 nodes gives all pairs; one with more compares its nodes with one of
them. Nodes of such keys that didn't come together with the most meet once more, by 384 keys of fourteen firsts each out of 384
other orders: at 0.8 these lose fewer than one pair in 1,000 too (the test counts it), while of a family of texts that are
0.5 alike only one pair in fifty meets, and each such pair is compared: nothing is left out.

Cases: texts without words (null, empty, blank) are one node; texts shorter than a shingle are one shingle; no rows give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACED, Words, as_bytes, grams, mix64
from .shared import components, stage
from .simhash import link_fingerprints, majority

WORDS_EACH, SIMILAR = 5, 0.8
#: Orders, keys and orders for each key: of all nodes, and of those that keys with many nodes left apart.
KEYS, LONG_KEYS = (128, 96, 8), (384, 384, 14)
#: Nodes of a key that are compared pair by pair in the first round.
MOST_NODES = 32
#: Shingles that are put in all orders at once.
STEP = 1 << 9


def _drawn(seed: int, orders: int, keys: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and addends of the orders, and which orders make up each key."""
    rng = np.random.default_rng(seed)
    times = rng.integers(0, 1 << 63, orders).astype(np.uint64) << np.uint64(1) | np.uint64(1)
    return times, rng.integers(0, 1 << 63, orders).astype(np.uint64), np.array([rng.choice(orders, each, replace=False) for _ in range(keys)])


SHORT, LONG = _drawn(17, *KEYS), _drawn(18, *LONG_KEYS)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the text's shingles, with repeats; of all its words if there are fewer than five; none without words."""
    h = Words([text], SPACED).hashes()
    return grams(h, min(WORDS_EACH, len(h))) if len(h) else h


def firsts(h: np.ndarray, drawn: tuple[np.ndarray, np.ndarray, np.ndarray] = SHORT) -> np.ndarray:
    """The least of a text's shingles in each order."""
    times, plus, _ = drawn
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), STEP):
        np.minimum(least, (h[a : a + STEP, None] * times + plus).min(axis=0), out=least)
    return least


def keys_of(h: np.ndarray, drawn: tuple[np.ndarray, np.ndarray, np.ndarray] = SHORT) -> np.ndarray:
    """The keys of a text's shingles."""
    least = firsts(h, drawn)[drawn[2]]
    out = np.arange(len(least), dtype=np.uint64)
    for k in range(least.shape[1]):
        out = mix64(out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _nodes(batches):
    """A text's node (a hash of its words), its fingerprint and its keys."""
    import xxhash

    for batch in batches:
        nodes, prints, keys = [], [], []
        for t in as_bytes(batch.column(1)):
            nodes.append(xxhash.xxh64_intdigest(b" ".join(t.lower().split())))
            h = shingles(t)
            prints.append(majority(h))
            keys.append(keys_of(np.unique(h)).view(np.int64) if len(h) else [])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), signed(nodes), signed(prints), pa.array(keys, pa.list_(pa.int64()))], names=["k", "node", "print", "keys"])


def _long_keys(batches):
    for batch in batches:
        keys = [keys_of(np.unique(shingles(t)), LONG).view(np.int64) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that have fingerprints within 3 bits, or equal ones: one node stands for each fingerprint."""
    first = stage(nodes.groupBy("print").agg(F.min("node").alias("first")), "minhash-prints")
    near = link_fingerprints(first.select("print"))
    of = lambda c: first.select(F.col("print").alias(c), F.col("first").alias(f"{c}_node"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return near.unionByName(nodes.join(first, "print").select(F.col("node").alias("a"), F.col("first").alias("b")))


def _shingle_sets(batches):
    """A node's different shingles, in order, and their number."""
    for batch in batches:
        sets = [np.unique(shingles(t)) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["node", "own", "n"])


def _alike(batches):
    for batch in batches:
        same = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            same.append(both >= SIMILAR * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, each once."""
    return texts.join(nodes.join(wanted, "node").select("k", "node"), "k").groupBy("node").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts are alike; ``texts``: k, text. Sets whose sizes already differ too much aren't compared."""
    pairs = stage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    of = stage(_texts_of(wanted, nodes, texts).mapInArrow(_shingle_sets, "node long, own binary, n long"), "minhash-sets")
    named = lambda c, own, n: of.select(F.col("node").alias(c), F.col("own").alias(own), F.col("n").alias(n))
    both = pairs.join(named("a", "x", "nx"), "a").join(named("b", "y", "ny"), "b").where(F.least("nx", "ny") >= SIMILAR * F.greatest("nx", "ny"))
    return stage(both.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"), "minhash-links")


def near_copies(texts: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """(k, root) for each row of texts (k: long, text): root is the same for texts that pairs of 0.8 or more connect."""
    found = stage(texts.select("k", "text").mapInArrow(_nodes, "k long, node long, print long, keys array<long>"), "minhash")
    nodes = stage(found.groupBy("node").agg(F.min("k").alias("k"), F.first("print").alias("print"), F.first("keys").alias("keys")), "minhash-nodes")
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    rows = stage(rows.join(groups, "key"), "minhash-keys")
    few, many = rows.where(F.col("n") <= most_nodes).select("key", "node"), rows.where(F.col("n") > most_nodes)
    near = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    star = many.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = _confirmed(_by_fingerprint(nodes).unionByName(near).unionByName(star), nodes, texts)
    groups = components(links)
    placed = many.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
    most = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    apart = placed.join(most, "key").groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("most")).alias("rest"))
    apart = stage(apart, "minhash-apart")
    if not apart.isEmpty():
        long = _texts_of(apart.select("node"), nodes, texts).mapInArrow(_long_keys, "node long, keys array<long>")
        long = stage(apart.join(long, "node").select(F.explode("keys").alias("key"), "node", "root", "rest"), "minhash-long")
        rest = long.where("rest").select("key", F.col("node").alias("a"), F.col("root").alias("of"))
        more = rest.join(long, "key").where("root <> of and (not rest or a < node)").select("a", F.col("node").alias("b"))
        groups = components(links.unionByName(_confirmed(more, nodes, texts)))
    return found.select("k", "node").join(groups, "node", "left").select("k", F.coalesce("component", "node").alias("root"))
