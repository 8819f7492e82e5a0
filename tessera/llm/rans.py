"""Token ids as binary blocks: a static range asymmetric numeral system (rANS) with shared frequencies.

``tokenise`` turns whole texts into ids, ``write_blocks`` writes them in ascending document order, ``read_blocks``
decodes them. A block holds whole documents, about ``BLOCK_IDS`` ids. Its ids go in turn to ``lanes`` independent
coders, so that one array step codes one id of every lane. Every ``CHECKPOINT_STEPS`` steps it keeps the coders'
states and the place in the words, where decoding can begin: parts of a block can be read, or read in parallel.
All blocks share one table of frequencies, which counts every id of the corpus.

Payload, little-endian: magic ``TRA1``; u32 each: ids, lanes, steps between checkpoints, checkpoints, words, crc32 of the
ids as u32, crc32 of the frequency table; then for each checkpoint (the first is at step 0) u32 place in the words and
a u64 state for each lane; the u32 words; u32 crc32 of all before it. Blocks lie as rows of Parquet files, which Spark
commits as a whole, with the ids and lengths of their documents.

Cases: a null text is empty and has only the end id; rows with equal or null ids each count (nulls first, ties by
their ids' bytes); an empty table gives no rows; texts of any length are coded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stage

END_ID = 2
SCALE_BITS = 18
LANES, BLOCK_IDS, CHECKPOINT_STEPS = 1024, 1 << 18, 128
LOW = np.uint64(1 << 31)
MAGIC = b"TRA1"
#: Words that a worker remembers the ids of; beyond that it starts anew.
CACHE_WORDS = 800_000
#: ASCII without control characters, which a byte-level model spells in another way.
PLAIN = re.compile(rb"[\x21-\x7E]+").fullmatch
#: Bytes of text that are taken up at once.
CHUNK = 4 << 20


class WordTokenizer:
    """A tokenizers file whose ids of a text are those of its white-space separated words, one after another.

    That holds where the normaliser and the pre-tokeniser never look across white space. Each distinct word is
    taken apart once, by the file's own normaliser and pre-tokeniser (ASCII words by the same pattern), and each
    distinct piece goes to the file's model once. Words are looked up with A-Z lower-cased where no combining mark
    could tell that from the library's own order of steps; texts with ``<|`` go to the library whole.
    """

    #: The pre-tokeniser's pattern, for lower-case ASCII.
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        pending: list[bytes] = []

        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                code = self[word] = len(self)
                pending.append(word)
                return code

        model = self.tok.model

        class Pieces(dict):
            def __missing__(self, piece: str) -> list[int]:
                ids = self[piece] = [t.id for t in model.tokenize(piece)]
                return ids

        self.codes, self.pending, self.pieces = Codes(), pending, Pieces()
        self.flat, self.start, self.length, self.used = np.zeros(1 << 20, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _learn(self) -> None:
        if not self.pending:
            return
        normal, split, pieces, ascii_pieces = self.tok.normalizer.normalize_str, self.tok.pre_tokenizer.pre_tokenize_str, self.pieces, self.ASCII_PIECES.findall
        got, ends = [], []
        for w in self.pending:
            if PLAIN(w):
                for p in ascii_pieces(w.lower().decode()):
                    got += pieces[p]
            else:
                for p, _ in split(normal(w.decode())):
                    got += pieces[p]
            ends.append(len(got))
        self.pending.clear()
        lengths = np.diff(np.array(ends, np.int64), prepend=0)
        ids = np.array(got, np.uint32)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], ids, np.zeros(self.used + len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id."""
        begin = 0
        while begin < len(texts):
            words, ends, whole, size, at = [], [], {}, 0, begin
            while at < len(texts) and (size < CHUNK or at == begin):
                data = (texts[at] or "").encode()
                size += len(data)
                if b"<|" in data:
                    whole[at - begin] = np.array(self.tok.encode(texts[at], add_special_tokens=False).ids, np.uint32)
                else:
                    words += (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()
                ends.append(len(words))
                at += 1
            if len(self.codes) > CACHE_WORDS:
                self._reset()
            codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            self._learn()
            lengths = self.length[codes]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.flat[np.repeat(self.start[codes] - upto[:-1], lengths) + np.arange(upto[-1])]
            first = 0
            for k, end in enumerate(ends):
                yield whole[k] if k in whole else ids[upto[first] : upto[end]]
                first = end
            begin = at


def vocabulary(name: str) -> str:
    """Where a file of the public tokenizers is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def quantise(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    total = int(counts.sum())
    f = np.zeros(len(counts), np.int64)
    if not total:
        return f
    present = counts > 0
    if present.sum() > 1 << bits:
        raise ValueError("more ids than the frequencies' scale has room for")
    f[present] = np.maximum(1, (counts[present].astype(np.float64) * ((1 << bits) / total)).astype(np.int64))
    rest = (1 << bits) - int(f.sum())
    order = np.argsort(-counts, kind="stable")
    if rest > 0:
        f[order[0]] += rest
    while rest < 0:  # too many ids were raised to 1: the frequent ones give it back
        for i in order:
            give = min(-rest, int(f[i]) // 2)
            f[i] -= give
            rest += give
            if not rest:
                break
    return f


class Coder:
    """Codes blocks of ids with one table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)[:-1]
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, lanes: int | None = None, every: int = CHECKPOINT_STEPS) -> bytes:
        n = len(ids)
        lanes = lanes or max(1, min(LANES, n // 64))
        f, c, shift, bits = self.freq[ids], self.cum[ids], np.uint64(32), np.uint64(self.bits)
        if n and not f.all():
            raise ValueError("an id that the table doesn't have")
        limit = f << np.uint64(31 - self.bits + 32)
        x = np.full(lanes, LOW, np.uint64)
        steps = -(-n // lanes)
        words, marks, written = [], [], 0
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y = x[: b - a]
            over = y >= limit[a:b]
            out = y[over].astype(np.uint32)
            y = np.where(over, y >> shift, y)
            q = y // f[a:b]
            x[: b - a] = (q << bits) + (y - q * f[a:b]) + c[a:b]
            words.append(out)
            written += len(out)
            if t % every == 0:
                marks.append((written, x.copy()))
        if not marks:
            marks.append((0, x))
        flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = struct.pack("<4s7I", MAGIC, n, lanes, every, len(marks), len(flat), zlib.crc32(ids.astype("<u4").tobytes()), self.crc)
        body = b"".join(struct.pack("<I", len(flat) - w) + s.astype("<u8").tobytes() for w, s in marks[::-1])
        data = head + body + flat.astype("<u4").tobytes()
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids, or those from ``first`` up to ``last`` from the checkpoint before them on; checksums are verified."""
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged: its checksum differs")
        magic, n, lanes, every, marks, count, crc, table = struct.unpack_from("<4s7I", data)
        if magic != MAGIC or table != self.crc:
            raise ValueError("not a block, or one of another frequency table")
        last = n if last is None else min(last, n)
        k = first // (every * lanes)
        at, width = 32, 4 + 8 * lanes
        words = np.frombuffer(data, "<u4", count, at + marks * width).astype(np.uint64)
        place = struct.unpack_from("<I", data, at + k * width)[0]
        x = np.frombuffer(data, "<u8", lanes, at + k * width + 4).copy()
        mask, bits, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32)
        begin = k * every * lanes
        out = np.empty(max(0, last - begin), np.uint32)
        for t in range(k * every, -(-last // lanes)):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y = x[: b - a]
            slot = y & mask
            s = self.slots[slot]
            out[a - begin : b - begin] = s[: max(0, last - a)]
            y = self.freq[s] * (y >> bits) + slot - self.cum[s]
            low = y < LOW
            m = int(np.count_nonzero(low))
            y[low] = (y[low] << shift) | words[place : place + m]
            place += m
            x[: b - a] = y
        if not first and last == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids differ from those encoded")
        return out[first - begin :]


TOKENS = "id long, n int, ids binary, seen array<int>, times array<long>"
BLOCKS = "part int, block int, doc_ids array<long>, lengths array<int>, n_ids long, payload binary"


def tokenise(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, n, ids as u16 or u32) for each document, and for each task a row with how often it saw each id."""

    def work(batches):
        tok = _tokenizer(path)
        vocab = max(tok.tok.get_vocab_size(), end_id + 1)
        kind, counts = np.uint16 if vocab <= 1 << 16 else np.uint32, np.zeros(vocab, np.int64)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            got = [np.append(x, np.uint32(end_id)).astype(kind) for x in tok.encode(batch.column(1).to_pylist())]
            for a in range(0, len(got), 4096):
                counts += np.bincount(np.concatenate(got[a : a + 4096]), minlength=vocab)
            none = [None] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in got], pa.int32()), pa.array([x.tobytes() for x in got], pa.binary()), pa.array(none, schema.field(3).type), pa.array(none, schema.field(4).type)], schema=schema)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([seen], schema.field(3).type), pa.array([counts[seen]], schema.field(4).type)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(work, TOKENS)


def write_blocks(tokens: DataFrame, vocab: int) -> tuple[DataFrame, np.ndarray]:
    """Writes the blocks in ascending order of id; returns them and the frequencies (no more of these than the vocabulary has ids)."""
    seen = tokens.where("n < 0").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("times"))
    counts = np.zeros(vocab, np.int64)
    for r in seen.toLocalIterator():
        counts[r["seen"]] = r["times"]
    freq = quantise(counts)
    kind = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")

    def work(batches):
        from pyspark import TaskContext

        coder, part, block = Coder(freq), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("payload", pa.binary())])
        held, names, size = [], [], 0

        def flush():
            nonlocal block, held, names, size
            ids = np.concatenate([np.frombuffer(x, kind) for x in held]).astype(np.uint32)
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([part], [block], [names], [[len(x) // kind.itemsize for x in held]], [len(ids)], [coder.encode(ids)]), schema, strict=True)], schema=schema)
            block, held, names, size = block + 1, [], [], 0
            return out

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(ids.as_py())
                names.append(name)
                size += len(held[-1]) // kind.itemsize
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    spark = tokens.sparkSession
    order = [F.col("id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    dealt = tokens.where("n >= 0").select("id", "ids").repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(work, BLOCKS), "token-blocks"), freq


def read_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """From the written blocks: doc_id, start, n_tokens, ids_crc32, with each block decoded and verified on its own."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("part", "block", "n_ids").withColumn("inner", inner).join(before, "part").select("part", "block", (F.col("part_start") + F.col("inner")).alias("start"))

    def work(batches):
        coder = Coder(freq)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for start, names, lengths, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = coder.decode(payload.as_py()).astype("<u4")
                lengths = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], schema=schema)

    joined = blocks.join(starts, ["part", "block"]).select("start", "doc_ids", "lengths", "payload")
    return joined.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes, writes and reads back: a row for each document."""
    tokens = stage(tokenise(docs, path, doc_id, text, end_id), "tokens")
    vocab = max(_tokenizer(path).tok.get_vocab_size(), end_id + 1)
    return read_blocks(*write_blocks(tokens, vocab))
