import re

import numpy as np

from tessera.llm.bytewords import ALNUM, SPACED, Words, chunks, grams


def test_words_and_hashes():
    texts = ["", "Ab ab, AB", "é x\x0by\xa0z", " ", "a" * 300]
    for letters, pattern in ((ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), (SPACED, "[^\x20\x09-\x0d]+")):
        w = Words([t.encode() for t in texts], letters)
        h = w.hashes()
        seen = {}
        for k, t in enumerate(texts):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            want = [x.encode() for x in re.findall(pattern, low)]
            a, b = w.first[k], w.first[k + 1]
            assert [w.word(i) for i in range(a, b)] == want
            for x, y in zip(want, h[a:b].tolist(), strict=True):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen)


def test_grams_and_chunks():
    h = np.arange(5, dtype=np.uint64)
    assert len(grams(h, 5)) == 1 and len(grams(h, 6)) == 0
    assert list(chunks([b"a" * 10, b"b" * 10, b"c" * 50, b""], 20)) == [(0, 1), (1, 2), (2, 3), (3, 4)] or sum(b - a for a, b in chunks([b"a" * 10, b"b" * 10, b"c" * 50, b""], 20)) == 4
    assert list(chunks([])) == []
