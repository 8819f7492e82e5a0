"""Repeated byte strings, found on Burrows-Wheeler transforms and removed.

Every byte covered by a string of ``least`` bytes that also starts elsewhere is removed. Each such string has an anchor: the
32 bytes in it with the smallest hash. Strings that are equal have equal anchors at equal places. So the strings around an
anchor are dealt by content: those that have it in their first half all hold the bytes right of it up to half a string, the
others the bytes left of it, and a hash of these bytes is their key. Strings whose key occurs once need no further look;
around the others the bytes of all strings of one key form a region. Equal regions are kept once, with their number. A
key with very many different regions is dealt again, by four narrower ranges of the anchor's place, whose strings have more
bytes in common, until its groups are small; the narrowest range is one string. Only different regions are dealt again,
each once with its number, and what is found goes back from the narrower regions to the wider ones they were cut from. So a
frequent passage costs one row for each half of a string around it each time it occurs, and a fixed number for each
different region; equal strings always meet.

Regions of the same keys meet in one task, which sorts their rotations, and finds where neighbours in that order share
less than ``least`` bytes: breadth-first backward extension on the transform gives the common prefixes by increasing value,
each interval going on only if it sets a new one, and stops at ``least``; what is still unset shares at least that much. An
interval of strings that holds more than one occurrence, by number of regions times their copies, is repeated.

Equal texts are looked at once, with their number.

Cases: null texts are empty; strings overlap freely and count within a document too; equal documents lose all their bytes
if they are long enough; rows with equal or null ids each get their row; texts of any length are read whole; no rows give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import INVERSE, MULTIPLIER, as_bytes, chunks, mix64, powers
from .shared import stage

LEAST, ANCHOR = 400, 32
#: Bytes that are hashed at once, the longest piece of a text, and bytes of regions in a batch.
CHUNK, PIECE, HELD = 1 << 20, 1 << 21, 4 << 20
#: Bytes of regions in a task's group, and that are sorted at once; different regions of a key beyond which it is dealt again.
BUCKET_BYTES, SORT_BYTES, MOST_REGIONS = 3 << 19, 1 << 19, 512
#: Ranges that a range of the anchor's places is dealt into: at first, and again.
HALVES, QUARTERS = 2, 4
SCANNED = "doc_id long, n_bytes long, sha string, k1 long, k2 long, own long, key long, lo int, off int, r1 int, r2 int, size int"
_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), *((c, pa.int64()) for c in ("k1", "k2", "own", "key")), *((c, pa.int32()) for c in ("lo", "off", "r1", "r2", "size"))])


def _sums(data: np.ndarray) -> np.ndarray:
    """From which the hash of any stretch of data follows."""
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(data)), out=upto[1:])
    return upto


def _stretch(upto: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (upto[b] - upto[a]) * powers(INVERSE, len(upto))[a]


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, k: int = ANCHOR):
    """Of concatenated texts: their sums, and (anchor, first and last start of the strings that have it), places in data."""
    n, upto = len(data), _sums(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return upto, none, none, none
    h = mix64((upto[k:] - upto[:-k]) * powers(INVERSE, n + 1)[: n - k + 1])
    # The smallest hash, then the leftmost place: both hang on the string alone.
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, have = least - k + 1, 1
    while have < width:
        by = min(have, width - have)
        low = np.minimum(low[: len(low) - by], low[by:])
        have += by
    size = end - begin - least + 1
    size = np.maximum(size, 0)
    starts = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    at = (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    if not len(at):
        return upto, none, none, none
    turn = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return upto, at[turn], starts[turn], starts[np.concatenate([turn[1:], [len(at)]]) - 1]


def deal(upto: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, r1: np.ndarray, r2: np.ndarray, parts: int, least: int = LEAST):
    """Strings (starts lo to hi, the anchor ``at``, which is r1 to r2 bytes after a start) dealt by narrower ranges.

    Returns (which string each is from, key, lo, hi, r1, r2): the key is a hash of the bytes that all strings of the range hold.
    """
    step = -(-(r2 - r1 + 1) // parts)
    out = []
    for k in range(parts):
        a, b = r1 + k * step, np.minimum(r1 + (k + 1) * step - 1, r2)
        low, high = np.maximum(lo, at - b), np.minimum(hi, at - a)
        i = np.flatnonzero((a <= r2) & (low <= high))
        key = mix64(_stretch(upto, at[i] - a[i], at[i] + least - b[i]) + mix64((a[i] << 16 | b[i]).astype(np.uint64)))
        out.append((i, key, low[i], high[i], a[i], b[i]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pieces(texts: list[bytes], least: int):
    """Texts as (index, offset, bytes): long ones in pieces that overlap by one string less a byte."""
    for k, t in enumerate(texts):
        step = PIECE - least
        for a in range(0, max(1, len(t) - least + 1), step):
            yield k, a, t[a : a + step + least - 1]


def _scan(batches, least: int):
    """For each text a row, and its dealt strings: key, where the region begins, the anchor in it, range and size."""
    none = pa.nulls
    for batch in batches:
        texts, own = as_bytes(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        shas = [hashlib.sha256(t).hexdigest() for t in texts]
        k1 = np.array([int(s[:15], 16) for s in shas], np.int64)
        k2 = np.array([int(s[15:30], 16) for s in shas], np.int64)
        n = len(texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas), pa.array(k1), pa.array(k2), pa.array(own, pa.int64()), none(n, pa.int64()), *(none(n, pa.int32()) for _ in range(5))], schema=_SCANNED)
        pieces = [p for p in _pieces(texts, least) if len(p[2]) >= least]
        for a, b in chunks([p[2] for p in pieces], CHUNK):
            part = [p[2] for p in pieces[a:b]]
            sizes = np.array([len(t) for t in part], np.int64)
            end = np.cumsum(sizes)
            begin = end - sizes
            upto, at, lo, hi = anchors(np.frombuffer(b"".join(part), np.uint8), begin, end, least)
            zero = np.zeros(len(at), np.int64)
            i, key, lo, hi, r1, r2 = deal(upto, at, lo, hi, zero, zero + (least - ANCHOR), HALVES, least)
            of = np.searchsorted(begin, lo, side="right") - 1
            doc = np.array([p[0] for p in pieces[a:b]], np.int64)[of]
            shift = np.array([p[1] for p in pieces[a:b]], np.int64)[of] - begin[of]
            m = len(key)
            yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.int64()), none(m, pa.string()), pa.array(k1[doc]), pa.array(k2[doc]), none(m, pa.int64()), pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (lo + shift, at[i] - lo, r1, r2, hi - lo + least))], schema=_SCANNED)


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of the rotations of text (small integers) by their first ``depth`` symbols or more, by doubling.

    Keys are sorted as plain 64-bit numbers with the place in the low bits, which is several times as fast as argsort.
    """
    n = len(text)
    place = np.arange(n, dtype=np.int64)
    low = max(1, (n - 1).bit_length())
    if low > 21:
        raise ValueError("too many symbols to sort at once")
    used = np.zeros(int(text.max()) + 1, bool)
    used[text] = True
    bits = max(1, int(used.sum() - 1).bit_length())
    dense = (np.cumsum(used) - 1)[text]
    have = (63 - low) // bits
    first = np.zeros(n, np.int64)
    for k in range(have):
        first = first << bits | np.roll(dense, -(k % n))
    key, rank = first, np.empty(n, np.int64)
    mask = (1 << low) - 1
    while True:
        packed = np.sort(key << low | place)
        order = packed & mask
        packed >>= low
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(packed[1:] != packed[:-1], out=new[1:])
        if have >= depth or new[-1] == n - 1:
            return order
        rank[order] = new
        key = rank << 21 | np.roll(rank, -(have % n))
        have *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each place in order shares at least ``least`` symbols with the one before it.

    Breadth-first backward extension: the intervals of all strings of one length are extended by each symbol before
    them; an interval that ends where no common prefix is known sets it to the length so far and goes on.
    """
    n = len(text)
    last = text[order - 1].astype(np.uint16)  # the transform
    by = np.argsort(last, kind="stable")
    to = np.empty(n, np.int32)
    to[by] = np.arange(n, dtype=np.int32)  # where the rotation one symbol longer stands
    bucket = last[by].astype(np.int32)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lb, size = np.array([0], np.int32), np.array([n], np.int32)
    parent_at = np.full(n, -1, np.int32)
    for length in range(least):
        total = int(size.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(lb), dtype=np.int32), size)
        rows = np.arange(total, dtype=np.int32) + np.repeat(lb - (np.cumsum(size, dtype=np.int32) - size), size)
        at = to[rows]
        if total * 8 > n:  # many: by place
            parent_at[at] = owner
            at = np.flatnonzero(parent_at >= 0)
            owner = parent_at[at]
            parent_at[at] = -1
        else:
            packed = np.sort(at.astype(np.int64) << 32 | owner)
            at, owner = (packed >> 32).astype(np.int32), packed.astype(np.int32)
        symbol = bucket[at]
        turn = np.ones(len(at), bool)
        turn[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        new = np.flatnonzero(turn)
        ends = np.append(new[1:], len(at))
        over = at[ends - 1] + 1
        fresh = unset[over]
        unset[over[fresh]] = False
        lb, size = at[new[fresh]], (ends - new)[fresh].astype(np.int32)
    return unset[:n]


def repeated_starts(regions: list[bytes], copies: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A flag for each byte of the joined regions (each followed by a separator): a repeated string starts there."""
    sizes = np.array([len(r) for r in regions], np.int64)
    text = np.frombuffer(b"\0".join([*regions, b""]), np.uint8).astype(np.int64) + 1
    end = np.cumsum(sizes + 1) - 1
    text[end] = 0
    n = len(text)
    order = rotations(text, least)
    same = common_prefixes(text, order, least)
    group = np.cumsum(~same) - 1
    weight = np.repeat(copies, sizes + 1).astype(np.int64)
    fits = np.zeros(n, bool)
    starts = np.repeat(end - sizes - (np.cumsum(sizes - least + 1) - (sizes - least + 1)), sizes - least + 1) + np.arange(int((sizes - least + 1).sum()))
    fits[starts] = True
    inside = fits[order]
    total = np.bincount(group[inside], weights=weight[order[inside]], minlength=int(group[-1]) + 1)
    out = np.zeros(n, bool)
    out[order[inside]] = total[group[inside]] > 1
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


SPANS = "key long, rid binary, lo array<int>, hi array<int>"
_SPANS = pa.schema([("key", pa.int64()), ("rid", pa.binary()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def _sort_bucket(table: pa.Table, least: int) -> pa.Table:
    """Of the regions of a bucket: which bytes lie in repeated strings. Keys are taken together while they fit SORT_BYTES."""
    table = table.sort_by("key")
    regions, copies, rids = table.column("region").to_pylist(), table.column("copies").to_numpy(), table.column("rid").to_pylist()
    key = table.column("key").to_numpy()
    turns = np.append(np.flatnonzero(np.diff(key)) + 1, len(key)).tolist()
    size = np.concatenate([[0], np.cumsum([len(r) + 1 for r in regions])])
    los, his, begin = [], [], 0
    for k, end in enumerate(turns):
        if k + 1 < len(turns) and size[turns[k + 1]] - size[begin] <= SORT_BYTES:
            continue
        flags, at = repeated_starts(regions[begin:end], copies[begin:end], least), 0
        for r in regions[begin:end]:
            a, b = _runs(flags[at : at + len(r)])
            los.append(a.astype(np.int32))
            his.append((b + least - 1).astype(np.int32))
            at += len(r) + 1
        begin = end
    return pa.table([pa.array(key), pa.array(rids, pa.binary()), pa.array(los, _SPANS.field(2).type), pa.array(his, _SPANS.field(3).type)], schema=_SPANS)


CUT = "k1 long, k2 long, n long, key long, lo int, off int, r1 int, r2 int, rid binary, region binary"
_CUT = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "n", "key")), *((c, pa.int32()) for c in ("lo", "off", "r1", "r2")), ("rid", pa.binary()), ("region", pa.binary())])
#: A region of a region: the wider one's key and rid, and where it begins in that.
AGAIN = "of_key long, of_rid binary, n long, key long, lo int, off int, r1 int, r2 int, rid binary, region binary"
_AGAIN = pa.schema([("of_key", pa.int64()), ("of_rid", pa.binary()), ("n", pa.int64()), ("key", pa.int64()), *((c, pa.int32()) for c in ("lo", "off", "r1", "r2")), ("rid", pa.binary()), ("region", pa.binary())])


def _rid(region: bytes, off: int) -> bytes:
    """Tells regions of a key apart, those with the anchor at another place too, as they are dealt otherwise."""
    import xxhash

    return xxhash.xxh3_128_digest(region, seed=off)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)


def _cut(batches):
    """The regions of each text: key, where it begins, the anchor in it, its range, a hash of its bytes and they themselves."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for k1, k2, n, t, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)), batch.column(4), strict=True):
            for key, lo, off, r1, r2, size in zip(*(marks.values.field(c).to_pylist() for c in ("key", "lo", "off", "r1", "r2", "size")), strict=True):
                region = t[lo : lo + size]
                held += size
                out.append((k1, k2, n, key, lo, off, r1, r2, _rid(region, off), region))
                if held > HELD:
                    yield _rows(out)
                    out, held = [], 0
        if out:
            yield _rows(out)


def _deal_again(batches, least: int):
    """Different regions (key, rid, copies, off, r1, r2, region) by narrower ranges of the anchor's place."""
    for batch in batches:
        regions = batch.column(6).to_pylist()
        for a, b in chunks(regions, HELD):
            part = regions[a:b]
            sizes = np.array([len(r) for r in part], np.int64)
            begin = np.cumsum(sizes) - sizes
            of_key, n, off, r1, r2 = (batch.column(c)[a:b].to_numpy().astype(np.int64) for c in (0, 2, 3, 4, 5))
            of_rid = batch.column(1)[a:b].to_pylist()
            data = b"".join(part)
            i, key, low, high, s1, s2 = deal(_sums(np.frombuffer(data, np.uint8)), begin + off, begin, begin + sizes - least, r1, r2, QUARTERS, least)
            cut = [data[x:y] for x, y in zip(low.tolist(), (high + least).tolist(), strict=True)]
            at = (begin + off)[i] - low
            for x in range(0, len(cut), 1 << 14):  # four narrower regions are up to four times the bytes
                s = slice(x, x + (1 << 14))
                j = i[s]
                ints = (low[s] - begin[j], at[s], s1[s], s2[s])
                rids = [_rid(r, o) for r, o in zip(cut[s], at[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of_key[j]), pa.array([of_rid[k] for k in j.tolist()], pa.binary()), pa.array(n[j]), pa.array(key[s].view(np.int64)), *(pa.array(y.astype(np.int32)) for y in ints), pa.array(rids, pa.binary()), pa.array(cut[s], pa.binary())], schema=_AGAIN)


def _text_key(text: Column) -> list[Column]:
    sha = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(sha, a, 15), 16, 10).cast("long").alias(k) for a, k in ((1, "k1"), (16, "k2"))]


def _remove(batches):
    """Of texts with their spans (not merged): what is left."""
    for batch in batches:
        out = []
        for k1, k2, t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3), strict=True):
            gone = np.zeros(len(t) + 1, np.int32)
            np.add.at(gone, spans.values.field(0).to_numpy(), 1)
            np.add.at(gone, spans.values.field(1).to_numpy(), -1)
            gone = np.cumsum(gone[:-1]) > 0
            out.append((k1, k2, int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


def _own(doc_id: Column) -> Column:
    """Tells rows with equal texts apart, but for those with equal ids."""
    return F.xxhash64(doc_id.cast("long"))


def repeated_spans(docs: DataFrame, text: str = "text", least: int = LEAST, doc_id: str = "doc_id", most_regions: int = MOST_REGIONS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row for each document (doc_id, n_bytes, sha, k1, k2, own), and the repeated spans of each distinct text (k1, k2, spans: (lo, hi); several rows a text, they may overlap)."""
    scanned = stage(docs.select(F.col(doc_id).cast("long"), text, _own(F.col(doc_id))).mapInArrow(lambda it: _scan(it, least), SCANNED), "suffix-scan")
    rows, marks = scanned.where("key is null"), scanned.where("key is not null")
    # Tables of their own: then both sides of the joins are shuffled for them, and Spark can split a key with many rows.
    twice = stage(marks.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "suffix-twice")
    marked = marks.join(twice, "key").select("k1", "k2", "key", "lo", "off", "r1", "r2", "size").distinct()
    per_text = marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "lo", "off", "r1", "r2", "size")).alias("marks"))
    equal = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("own").alias("own"))
    per_text = stage(equal.join(per_text, ["k1", "k2"]), "suffix-marks")
    cut = stage(_one_of_each(docs, text, doc_id, per_text).select("k1", "k2", "n", "text", "marks").mapInArrow(_cut, CUT), "suffix-regions")

    cuts, found = [], []
    while cut is not None:
        first = [F.first(c).alias(c) for c in ("off", "r1", "r2", "region")]
        regions = stage(cut.groupBy("key", "rid").agg(F.sum("n").alias("copies"), *first), "suffix-distinct")
        of_key = stage(regions.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("all"), F.sum(F.length("region")).alias("size")).where("all > 1"), "suffix-keys")
        few = of_key.where(F.col("different") <= most_regions).select("key", "size")
        size = few.agg(F.sum("size")).first()[0] or 0
        bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // BUCKET_BYTES))))
        got = regions.join(few.select("key"), "key").withColumn("bucket", bucket).select("bucket", "key", "rid", "copies", "region").groupBy("bucket").applyInArrow(lambda key, t: _sort_bucket(t, least), SPANS)
        found.append(stage(got.select("key", "rid", F.arrays_zip("lo", "hi").alias("spans")).where("size(spans) > 0"), "suffix-spans"))
        cuts.append(cut)
        many = of_key.where(F.col("different") > most_regions).select("key")
        again = regions.join(many, "key").select("key", "rid", "copies", "off", "r1", "r2", "region").mapInArrow(lambda it: _deal_again(it, least), AGAIN)
        cut = None if many.isEmpty() else stage(again, "suffix-again")

    # From the narrowest regions back to those of the texts; regions and what is found in narrower ones have keys of their own.
    moved = F.expr("transform(spans, s -> struct(s.lo + lo as lo, s.hi + lo as hi))").alias("spans")
    got = found.pop()
    while found:
        wider = cuts.pop().select("of_key", "of_rid", "key", "rid", "lo").join(got, ["key", "rid"]).select(F.col("of_key").alias("key"), F.col("of_rid").alias("rid"), moved)
        got = found.pop().unionByName(wider.groupBy("key", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans")))
        got = stage(got, "suffix-wider") if found else got
    spans = cuts.pop().select("k1", "k2", "key", "rid", "lo").join(got, ["key", "rid"]).select("k1", "k2", moved)
    return rows.select("doc_id", "n_bytes", "sha", "k1", "k2", "own"), spans


def _one_of_each(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame) -> DataFrame:
    """The texts (k1, k2, text) that ``wanted`` names by k1, k2 and own, with its columns; once each, however many rows are equal."""
    texts = docs.select(*_text_key(F.col(text)), _own(F.col(doc_id)).alias("own"), F.col(text).alias("text"))
    more = [c for c in wanted.columns if c not in ("k1", "k2", "own")]
    return texts.join(wanted, ["k1", "k2", "own"]).groupBy("k1", "k2", "own").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in more))


def remove_repeats(docs: DataFrame, text: str = "text", least: int = LEAST, doc_id: str = "doc_id", most_regions: int = MOST_REGIONS) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(docs, text, least, doc_id, most_regions)
    per_text = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    wanted = stage(rows.groupBy("k1", "k2").agg(F.min("own").alias("own")).join(per_text, ["k1", "k2"]), "suffix-per-text")
    gone = _one_of_each(docs, text, doc_id, wanted).select("k1", "k2", "text", "spans").mapInArrow(_remove, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
    gone = stage(gone, "suffix-removed")
    none = F.lit(0).cast("long")
    return rows.join(gone, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
