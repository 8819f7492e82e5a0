"""Benchmark decontamination by winnowing.

Of every 9 consecutive 5-word hashes of a text the smallest is a fingerprint. Two texts that share 13 words share all
9 hashes of some window, and so the fingerprint in it. Fingerprints of documents that a bitmap of the items' (of fixed
size, so it can be broadcast; a false hit only costs work) lets through go, with the words around them, into a join with the
items' fingerprints, and each match is extended in both directions word by word: 13 or more equal words are hits.
An item of fewer than 13 words is one window of its own length; documents have all hashes of those few lengths looked up.

Cases: null texts have no words; items without words match nothing; rows with one item_id are one item; rows with one doc_id
each get their row (inner row numbers, not doc_ids, tell rows apart); empty tables give no rows, or clean ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, as_bytes, chunks, grams, mix64
from .shared import fresh, row_key, stage

WINDOW, GRAM = 13, 5
#: Bits of the bitmap of the items' fingerprints: 4 MB, whatever the number of items.
BITMAP_BITS = 1 << 25
PRINTS = "row long, id long, n_words long, length int, print long, at int, before array<string>, after array<string>"


def winnow(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Places of the fingerprints among the gram hashes of word hashes h (at least ``window`` of these)."""
    g = grams(h, gram)
    w = window - gram + 1
    if len(g) < w:
        return np.zeros(0, np.int64)
    # The smallest of each w in a row, by doubling; equal hashes: all of them, so that the choice hangs on content alone.
    low, have = g, 1
    while have < w:
        by = min(have, w - have)
        low = np.minimum(low[: len(low) - by], low[by:])
        have += by
    chosen = np.zeros(len(g), bool)
    for k in range(w):
        part = g[k : k + len(low)]
        chosen[k : k + len(low)] |= part == low
    return np.flatnonzero(chosen)


def _prints(batches, lengths: list[int], bitmap: np.ndarray | None):
    """For each text a row (length 0) with its number of words, and its fingerprints with the words around each."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("length", pa.int32()), ("print", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
    for batch in batches:
        rows, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
        out: list[tuple] = []
        for a, b in chunks(texts):
            words = Words(texts[a:b], ALNUM)
            h = words.hashes()
            # All texts of the chunk at once; grams that cross from one text to the next are told apart below.
            of = np.repeat(np.arange(b - a), np.diff(words.first))
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            spans = [WINDOW] if bitmap is not None else []
            for k in range(b - a):
                n = int(words.first[k + 1] - words.first[k])
                out.append((rows[a + k], ids[a + k], n, 0, None, None, None, None))
            if bitmap is not None:
                if len(h) >= WINDOW:
                    g = grams(h, GRAM)
                    hit = _in(bitmap, g) & (of[: len(g)] == of[GRAM - 1 :])
                    if hit.any():
                        for k in np.unique(of[: len(g)][hit]):
                            i, j = words.first[k], words.first[k + 1]
                            p = winnow(h[i:j])
                            p = p[hit[i + p]] + i
                            found.append((WINDOW, p, g[p]))
                for n in lengths:
                    g = grams(h, n)
                    p = np.flatnonzero(_in(bitmap, mix64(g + np.uint64(n))) & (of[: len(g)] == of[n - 1 :])) if len(g) else np.zeros(0, np.int64)
                    found.append((n, p, g[p]))
            else:
                for k in range(b - a):
                    i, j = words.first[k], words.first[k + 1]
                    if j - i >= WINDOW:
                        p = winnow(h[i:j]) + i
                        found.append((WINDOW, p, grams(h[i:j], GRAM)[p - i]))
                    elif j > i:
                        found.append((int(j - i), np.array([i]), grams(h[i:j], int(j - i))))
            for length, places, prints in found:
                gram = GRAM if length == WINDOW else length
                for p, x in zip(places.tolist(), prints.view(np.int64).tolist(), strict=True):
                    k = of[p]
                    i, j = int(words.first[k]), int(words.first[k + 1])
                    reach = WINDOW - GRAM if length == WINDOW else 0
                    before = [words.word(q).decode() for q in range(max(i, p - reach), p)]
                    after = [words.word(q).decode() for q in range(p, min(j, p + gram + reach))]
                    out.append((rows[a + k], ids[a + k], None, length, x, p - i, before, after))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(8)) & np.uint64(BITMAP_BITS - 1)


def _in(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = _slot(x)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _extended(batches):
    """The words of the document that lie in windows that the item has too: from and to (not included), if there are any."""
    schema = pa.schema([("row", pa.int64()), ("item", pa.int64()), ("item_id", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
    for batch in batches:
        out = []
        for row, item, item_id, length, at, before, after, b, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            right = 0
            for x, y in zip(after, a, strict=False):
                if x != y:
                    break
                right += 1
            left = 0
            for x, y in zip(reversed(before), reversed(b), strict=False):
                if x != y:
                    break
                left += 1
            if right >= (GRAM if length == WINDOW else length) and left + right >= length:
                out.append((row, item, item_id, at - left, at + right))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _covered(spans):
    """The number of words in the union of an array of struct(lo, hi), sorted."""
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["hi"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", one_in: int = 20) -> DataFrame:
    """A row for each document: doc_id, row (inner number), n_words, n_hit, n_items, items (sorted ids), longest (words of the longest match with one item), contaminated."""
    spark = docs.sparkSession
    items = stage(items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text")), "items")
    names = items.select("item", "item_id")
    of_items = stage(items.select("item", F.lit(0).cast("long"), "text").mapInArrow(lambda it: _prints(it, [], None), PRINTS), "item-prints")
    prints = of_items.where("length > 0").select("length", "print").distinct()
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect() if r["length"] < WINDOW)

    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)

    def own(batches):
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for batch in batches:
            n, x = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().view(np.uint64)
            at = _slot(np.where(n == WINDOW, x, mix64(x + n)))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    for r in prints.repartition(4).mapInArrow(own, "bits binary").toLocalIterator():  # 4 bitmaps, whatever the number of items
        bitmap |= np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    got = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), text).mapInArrow(lambda it: _prints(it, lengths, shared.value), PRINTS), "doc-prints")

    theirs = of_items.where("length > 0").select(F.col("row").alias("item"), "length", "print", F.col("before").alias("b"), F.col("after").alias("a"))
    pairs = got.where("length > 0").join(theirs, ["length", "print"]).join(names, "item").select("row", "item", "item_id", "length", "at", "before", "after", "b", "a")
    spans = pairs.mapInArrow(_extended, "row long, item long, item_id string, lo int, hi int").distinct()
    hits = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    longest = F.array_max(F.transform("spans", lambda x: x["hi"] - x["lo"]))
    hits = hits.select("row", _covered(F.col("spans")).cast("long").alias("n_hit"), "items", longest.alias("longest"))
    out = got.where("length = 0").select("row", F.col("id").alias("doc_id"), "n_words").join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.expr("cast(array() as array<string>)")
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items").cast("long"), F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"), ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (doc_id and text among the columns) that share no window of 13 words with an item and aren't contaminated.

    A whole window lets a document go however long it is; the few words of a shorter item do so only if they are 5 % of it.
    """
    key, other = fresh(docs, "winnow_key"), fresh(docs, "winnow_other")
    keyed = docs.withColumn(key, row_key(docs))
    numbered = keyed.select(F.col(key).alias("id"), "text")
    found = decontaminate(numbered, items, doc_id="id").where((F.col("longest") >= WINDOW) | F.col("contaminated")).select(F.col("doc_id").alias(other)).distinct()
    return keyed.join(stage(found, "contaminated"), F.col(key) == F.col(other), "left_anti").select(*docs.columns)
