"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has bit b if more than half the XXH64 hashes of its word shingles have it. Fingerprints link at 3
or fewer differing bits. Their four 16-bit segments lie in a ring: of two that link, the differences from some segment on
stay within the budget in proportion all along the ring: none in that segment, at most 1 in two, 2 in three, 3 in
all. So the first segment of the chain as it is and the second with at most one bit changed make a 32-bit key
under which the pair meets; the rest of the chain is checked before the full distance.

Equal fingerprints are one node. A key with so many fingerprints that its pairs are too many goes another, also exact
way: each fingerprint y that is within 2 bits of a pattern z is linked to one of those within 1 bit of z. All of these are
within 3 bits of y, and any pair within 3 bits has such a z between; so components come out the same in linear work.

Cases: texts without words (null, empty, blank) have fingerprint zero and link like any other; texts shorter than a
shingle are one shingle; repeated rows share a node; a component's id is its smallest doc_id, nulls aside; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import as_bytes
from .shared import components, fresh, row_key, stage

SEED, DISTANCE = 42, 3
#: Pairs of one key that are formed one by one; a key with more goes the other way.
MOST_PAIRS = 4096
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The fingerprint of UTF-8 bytes, A-Z lower-cased, unsigned."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - words_each + 1)
    h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(words_each)), strict=False)) if len(words) >= words_each else iter([digest(b" ".join(words), SEED)]), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), STEP):
        part = h[a : a + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words_each: int = 3) -> DataFrame:
    """The kept columns and ``print``, the fingerprint's 64 bits as a long."""
    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "print long"

    def work(batches):
        for batch in batches:
            got = np.array([fingerprint(t, words_each) for t in as_bytes(batch.column(len(keep)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(got.view(np.int64))], names=[*keep, "print"])

    return docs.select(*keep, text).mapInArrow(work, ddl)


def _segment(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def _mask(*segments: int) -> int:
    """The long that covers these segments of the ring."""
    bits = 0
    for k in segments:
        bits |= 0xFFFF << 16 * (k % 4)
    return _long(bits)


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _chain_keys(p: Column, start: int) -> tuple[Column, Column]:
    """Arrays of struct(key, flipped): the chain's first two segments as they are, and with one more bit of the second set.

    A bit that differs is 0 in one of two fingerprints: that one looks the other up with the bit set.
    """
    second = _segment(p, start + 1)
    key = F.lit(start << 32).bitwiseOR(F.shiftleft(_segment(p, start), 16)).bitwiseOR(second)
    unset = F.filter(F.array(*[F.lit(1 << b) for b in range(16)]), lambda b: second.bitwiseAND(b) == 0)
    return F.array(F.struct(key.alias("key"), F.lit(False).alias("flipped"))), F.transform(unset, lambda b: F.struct(key.bitwiseOR(b).alias("key"), F.lit(True).alias("flipped")))


def link_fingerprints(nodes: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (print: long) that leave them in the same components as all pairs within 3 bits."""
    keys = [k for start in range(4) for k in _chain_keys(F.col("print"), start)]
    rows = nodes.select("print", F.explode(F.concat(*keys)).alias("x")).select("print", "x.key", "x.flipped")
    of_key = rows.groupBy("key").agg(F.sum(F.when(F.col("flipped"), 0).otherwise(1)).alias("own"), F.count("*").alias("all")).where("own > 0 and all > 1")
    # A table of its own: both sides of the join are shuffled for it, and Spark can split a key with many rows.
    rows = stage(rows.join(stage(of_key, "simhash-shared"), "key"), "simhash-keys")
    cold = rows.where(F.col("own") * F.col("all") <= most_pairs)
    a, b = cold.select("key", F.col("print").alias("a"), "flipped"), cold.where(~F.col("flipped")).select("key", F.col("print").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    third = F.element_at(F.array(*[F.lit(_mask(k, k + 1, k + 2)) for k in range(4)]), (F.shiftright("key", 32) + 1).cast("int"))
    near = a.join(b, "key").where((F.col("flipped") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & (F.bit_count(x.bitwiseAND(third)) <= 2) & (F.bit_count(x) <= DISTANCE)).select("a", "b")

    hot = rows.where(F.col("own") * F.col("all") > most_pairs).select("print").distinct()
    one = [0, *(1 << i for i in range(64))]
    two = [*one, *(1 << i | 1 << j for i in range(64) for j in range(i))]
    around = lambda masks: hot.select("print", F.explode(F.transform(F.expr("array(" + ",".join(f"{_long(m)}L" for m in masks) + ")"), lambda m: m.bitwiseXOR(F.col("print")))).alias("z"))
    centres = around(one).groupBy("z").agg(F.min("print").alias("b"))
    far = around(two).join(centres, "z").where("print <> b").select(F.col("print").alias("a"), "b").distinct()
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 3) -> DataFrame:
    """doc_id, print, component_id (the smallest doc_id reachable) and root (the component's inner name) of each row."""
    prints = stage(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words_each=words_each), "simhash")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    groups = components(link_fingerprints(nodes.select("print"))).withColumnRenamed("node", "print")
    named = nodes.join(groups, "print", "left").withColumn("root", F.coalesce("component", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stage(named.join(least, "root").select("print", "component_id", "root"), "simhash-groups")
    return prints.join(labels, "print").select("doc_id", "print", "component_id", "root")


def one_of_each(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """The rows of docs (doc_id and text among the columns) without near-duplicates: of each component the row with the smallest doc_id, nulls last."""
    return first_of_each(docs, lambda keyed: near_duplicates(keyed, doc_id="k", words_each=words_each).select(F.col("doc_id").alias("k"), "root"))


def first_of_each(docs: DataFrame, group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs with the smallest doc_id of each group, nulls last; ``group`` gives k and root for rows of k and text."""
    key, other, nth = fresh(docs, "simhash_key"), fresh(docs, "simhash_other"), fresh(docs, "simhash_nth")
    keyed = docs.withColumn(key, row_key(docs))
    found = group(keyed.select(F.col(key).alias("k"), "text")).distinct()
    ids = keyed.select(F.col(key).alias("k"), "doc_id").distinct()
    first = found.join(ids, "k").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("kept"))
    kept = stage(first.select(F.col("kept.k").alias(other)), "simhash-kept")
    joined = keyed.join(kept, F.col(key) == F.col(other))
    # Rows that are the same: one of them.
    return joined.withColumn(nth, F.row_number().over(Window.partitionBy(other).orderBy(other))).where(F.col(nth) == 1).select(*docs.columns)
