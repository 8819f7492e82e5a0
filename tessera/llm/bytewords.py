"""Words and their hashes for many texts at once, as array operations on their bytes."""

from __future__ import annotations

import numpy as np

#: An odd multiplier (2**64 over the golden ratio) and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Bytes of texts that are taken at once: with what is added between them, tables of powers stay below 2**20.
CHUNK = (1 << 20) - (1 << 14)
_POWERS: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """of**0 up to of**(n - 1) modulo 2**64; the longest so far is kept."""
    have = _POWERS.get(of)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        p = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            p[filled : 2 * filled] = p[:filled] * np.uint64(pow(of, filled, 1 << 64))
            filled *= 2
        have = _POWERS[of] = p
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(keep) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(keep)] = True
    return t


#: Bytes of words: letters and digits and all that isn't ASCII; or all but ASCII white space.
ALNUM = _table([b for b in range(256) if b >= 128 or chr(b).isalnum()])
SPACED = _table([b for b in range(256) if b != 32 and not 9 <= b <= 13])
#: A-Z lower-cased; other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of some texts: data (lower-cased bytes), start and end of each word, ``first``: where each text's words begin."""

    def __init__(self, texts: list[bytes], letters: np.ndarray):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # one space after each text: no word crosses
        self.data = LOWER[raw]
        inside = letters[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.begins = begins

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n), out=upto[1:])
        span = (upto[self.end] - upto[self.start]) * powers(INVERSE, n + 1)[self.start]
        return mix64(span + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def text(self, i: int, j: int) -> bytes:
        """Words i up to j, joined by single spaces."""
        return b" ".join(self.word(k) for k in range(i, j))


def chunks(texts: list[bytes], size: int = CHUNK):
    """(first, last) of runs of texts with about that many bytes each; a longer text is a run of its own."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, k
            begin, held = k, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of a string column of Arrow; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes; none if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m, out = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(MULTIPLIER) + h[k : k + m]
    return mix64(out)
