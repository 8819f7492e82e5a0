"""Winnowing, SimHash, tokens, main texts, url rules and repeats against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import density, rans, simhash, suffix, winnow
from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.shared import components
from tessera.llm.url_rules import judge_urls

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df, want = QUERIES[name](spark, sf), c.sql(ORACLE[name])
    cols = sorted(df.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


# -- decontamination ---------------------------------------------------------------------------------------------------


def hits(text, items):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for i, t in items:
        w = WORDS.findall((t or "").lower())
        n = min(13, len(w))
        have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in have:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_winnowing(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 12, 13, 14, 40]))) for i in range(1, 12)] + [(99, None), (100, ""), (1, say(20)), (7, "Ein Satz, DER kurz ist")]
    docs = []
    for k in range(40):
        own = (r.choice(items)[1] or "").split()
        a = r.randint(0, max(0, len(own) - 1))
        docs.append((k % 37, None if k == 5 else " ".join([say(r.randint(0, 40)), *own[a : a + r.randint(1, 30)], say(r.randint(0, 9))]).upper() if k % 5 == 0 else " ".join([say(r.randint(0, 40)), *own[a:], say(3)])))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as at", "3 as print")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as item")
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in winnow.decontaminate(d, i).collect())
    merged = [(k, t) for k, t in items]
    want = []
    for k, t in docs:
        n, h, f = hits(t, merged)
        want.append((k, n, h, f, h > 0 and 20 * h >= n))
    assert got == sorted(want)
    kept = winnow.clean_documents(d, i)
    assert kept.columns == d.columns and kept.count() == sum(not w[-1] for w in want)


def test_winnowing_odd(odd, none, spark):
    items = spark.createDataFrame([(1, "same words in here again"), (None, "w1")], "item_id long, text string")
    out = winnow.decontaminate(odd, items)
    assert out.count() == odd.count() and out.where("contaminated and n_hit = 5").count() == 4
    assert winnow.decontaminate(none, items).count() == 0
    assert winnow.decontaminate(odd, items.where("false")).where("contaminated").count() == 0
    assert winnow.clean_documents(odd, items).columns == odd.columns


def test_fingerprints_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, 13).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 1 << 60, 9).astype(np.uint64)]) for _ in range(2))
        prints = lambda h: set(winnow.grams(h, 5)[winnow.winnow(h)].tolist())
        assert prints(a) & prints(b) & set(winnow.grams(shared, 5).tolist())


# -- SimHash -----------------------------------------------------------------------------------------------------------


def plain_print(text, n=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    keys = sorted(set(prints))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs}
    root = grouped(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("most_pairs", [4096, 0])
def test_links(spark, most_pairs):
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:6]:
        at = base
        for _ in range(12):
            for b in r.sample(range(64), r.randint(1, 3)):
                at ^= 1 << b
            prints.add(at)
            at = at if r.random() < 0.5 else base
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "print long")
    label = {row["node"]: row["component"] for row in components(simhash.link_fingerprints(nodes, most_pairs)).collect()}
    want = Counter(Counter(grouped(prints).values()).values())
    sizes = Counter(Counter(label.values()).values())
    sizes[1] += len(prints) - len(label)
    assert +sizes == want


def test_simhash_odd(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["print"] == 0} == {0}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("text = 'same words in here again'").count() == 1 and kept.where("text is null or trim(text) = ''").count() == 1
    assert simhash.one_of_each(none).count() == 0 and simhash.near_duplicates(none).count() == 0


# -- tokens ------------------------------------------------------------------------------------------------------------

PATH = rans.vocabulary("word_bpe_49k.json")


def test_word_tokenizer(odd):
    own = rans.WordTokenizer(PATH)
    texts = [r["text"] for r in odd.select("text").collect()] + ["H\u0331 \u0130stanbul \u03a3\u0391\u03a3", "don't WE'LL x2y 12", "a\x0bb\x1cc\x85d\u2003e\x00f", "x<|endoftext|>Y <|ENDOFTEXT|>", "ﬁ ３ Ⅷ \u200b\ufeff"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.tok.encode(t or "", add_special_tokens=False).ids, t


def test_round_trip(spark, odd, none):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd.collect()), key=lambda r: r[:2])
    tok = rans.WordTokenizer(PATH).tok
    got = rans.write_and_read(odd, PATH).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i if k else None, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, i, t in rows for x in [tok.encode(t or "", add_special_tokens=False).ids + [2]])
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i if k else None for k, i, _ in rows]
    assert rans.write_and_read(none, PATH).count() == 0


def test_coder():
    rng = np.random.default_rng(0)
    ids = (rng.pareto(1.0, 50_000) * 3).astype(np.int64) % 5000
    coder = rans.Coder(rans.quantise(np.bincount(ids, minlength=6000)))
    for n, lanes, every in ((0, None, 128), (1, None, 128), (999, 7, 3), (50_000, 64, 16)):
        data = coder.encode(ids[:n], lanes, every)
        assert (coder.decode(data) == ids[:n]).all() and (coder.decode(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    with pytest.raises(ValueError):
        coder.decode(data[:500] + bytes([data[500] ^ 1]) + data[501:])
    with pytest.raises(ValueError):
        coder.encode(np.array([5999]))
    f = rans.quantise(np.array([10**9, 1, 0, 1]))
    assert f.sum() == 1 << rans.SCALE_BITS and (f > 0).tolist() == [True, True, False, True]
    assert rans.quantise(np.ones(1 << rans.SCALE_BITS, np.int64)).max() == 1


# -- pages -------------------------------------------------------------------------------------------------------------


def test_main_text():
    page = '<!doctype html><html><head><title>t</title><script>var x="<p>no</p>";</script></head><body class=form><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div id="cookie-notice">We use cookies and so on and on.</div><article><h1>Title &amp; more</h1><p>First\n  <i>para</i>graph&nbsp;here.<p>Second <a href=2>link</a> one<br>goes on.<aside>Related things to read</aside><ul><li>item one<li>item two</ul><form>Your name <input></form><section class="comments"><p>What a nice article this is, thanks!</section></article><div class="ad">Buy now</div><footer>&copy;</footer>'
    assert density.extract(page) == "Title & more\nFirst paragraph here.\nSecond link one goes on.\nitem one\nitem two"
    soup = "<body><div><a href=1>a</a> <a href=2>b</a></div><div><h2>Head</h2><div>" + "".join(f"<p>{'long text of sentence ' * 9}{k}</p>" for k in range(5)) + "</div></div><div><a href=3>next page</a></div>"
    out = density.extract(soup)
    assert out.startswith("Head\nlong text") and out.endswith("sentence 4") and "next page" not in out
    assert density.extract(None) == density.extract("") == density.extract("<script>x</script>") == "" and density.extract("plain") == "plain"
    assert density.extract("<div>" * 5000 + "deep") == "deep"


def test_pages_query(spark, sf):
    for r in QUERIES["op4_main_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_odd(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, "u", "")], "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    assert sorted((r["text"] for r in density.main_text(df).collect())) == ["", "", "x"]
    assert density.main_text(df.where("false")).count() == 0


# -- urls --------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    r = random.Random(1)
    hosts, paths = ["com", "a.com", "b.a.com", "x.org", "org", "", "A.com", "..com", "com."], ["", "/", "/en", "/en/", "/en/7", "/en/77/x", "/d"]
    urls = [f"http{'s' * (k % 2)}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#x'])}" for k in range(400)] + [None, "", "no scheme", "://", "x://y://z/"] + ["http://a.com/en/7"] * 300
    rules = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("b.a.com", "", "block"), ("com", "/en/77", "block"), ("org", "/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("a.com", None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as key", "2 as row", "3 as path", "4 as host", "5 as kept")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), keep=("page_id",)).collect()}
    for k, u in enumerate(urls):
        rest = u.partition("://")[2] if u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h) + len(p or ""), len(h), h + (p or ""), v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fit, default=None)
        assert got[k] == (host, path, best and best[2], best[3] if best else "allow"), u
    assert judge_urls(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == len(urls)


# -- repeats -----------------------------------------------------------------------------------------------------------


def without_repeats(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + least] for t in data for k in range(len(t) - least + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = [True] * least
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most_regions", [suffix.MOST_REGIONS, 8])
def test_repeats(spark, most_regions):
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh \né") for _ in range(3000))
    texts = [None, "", "short", base[:800], base[:800], base[100:1400], base[2000:] + base[500:1000], "x" * 900, "ab" * 700]
    for _ in range(25):
        a = r.randint(0, 2500)
        t = list(base[a : a + r.randint(100, 900)])
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = "Z"
        texts.append("".join(t))
    df = spark.createDataFrame([(k % 30, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as k1", "2 as anchor", "3 as lo", "4 as sha")
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.remove_repeats(df, most_regions=most_regions).collect())
    assert got == Counter((k % 30, *w) for k, w in enumerate(without_repeats(texts, 400)))
    assert suffix.remove_repeats(df.where("false")).count() == 0


def test_planted_passages(spark):
    """Passages of 400 bytes or more in otherwise different texts go, whole; shorter ones stay; also far into a long text."""
    r = random.Random(4)
    say = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    passages = [say(n) for n in (399, 400, 401, 900)]
    edges = string.digits + string.ascii_uppercase + string.punctuation  # a byte each that differs before and after every copy
    texts, want = [], []
    for k in range(160):
        p = passages[k % 4]
        texts.append(say(r.randint(50, 700)) + edges[k // 4] + p + edges[-1 - k // 4] + say(60))
        want.append(0 if len(p) < 400 else len(p))
    long = say(2 * suffix.PIECE + 5000)
    for at in (0, suffix.PIECE - 700, suffix.PIECE - suffix.LEAST, 2 * suffix.PIECE - 1000):
        texts.append("#" + long[at : at + 500] + "#")
        want.append(500)
    texts.append(long)
    want.append(1700 + (suffix.PIECE - suffix.LEAST + 500) - (suffix.PIECE - 700) - 700)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["n_removed"] for x in suffix.remove_repeats(df, most_regions=16).collect()}
    assert got == dict(enumerate(want))


def test_dealt_rows_grow_with_the_input():
    """A passage in very many texts costs a fixed number of rows each time, at each narrowing."""
    r = np.random.default_rng(6)
    passage = r.integers(97, 123, 420).astype(np.uint8).tobytes()
    for times in (20, 200):
        parts = [r.integers(97, 123, 300).astype(np.uint8).tobytes() + passage + r.integers(97, 123, 300).astype(np.uint8).tobytes() for _ in range(times)]
        end = np.cumsum([len(p) for p in parts])
        begin = end - 1020
        upto, at, lo, hi = suffix.anchors(np.frombuffer(b"".join(parts), np.uint8), begin, end)
        assert (hi - lo + 1).sum() == times * (1020 - suffix.LEAST + 1)
        r1, r2, level = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64) + suffix.LEAST - suffix.ANCHOR, 0
        while len(at):
            i, key, lo, hi, r1, r2 = suffix.deal(upto, at, lo, hi, r1, r2, suffix.QUARTERS)
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            shared = (n > 1)[back]
            # Keys that more texts than one hold; those of one different region (a string each, at last) are done.
            keep = shared & (r2 > r1)
            at, lo, hi, r1, r2, level = at[i][keep], lo[keep], hi[keep], r1[keep], r2[keep], level + 1
            assert len(key) <= 160 * times
        assert level <= 6


def test_repeats_deal_different_regions_again_once(spark, monkeypatch):
    r = random.Random(5)
    say = lambda n: "".join(r.choice("abcdefgh \n") for _ in range(n))
    middle, least = say(500), 400
    passages = [say(300) + middle + say(300) for _ in range(3)]
    texts = [say(50) + passages[k % 3] + say(50) for k in range(60)]
    again, stage = [], suffix.stage

    def counted(df, name, *by):
        out = stage(df, name, *by)
        again.append(out.count()) if name == "suffix-again" else None
        return out

    monkeypatch.setattr(suffix, "stage", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.remove_repeats(df, most_regions=1).collect()}
    assert got == dict(enumerate(without_repeats(texts, least)))
    few = sum(again)
    again.clear()
    suffix.remove_repeats(spark.createDataFrame(list(enumerate(t + str(k) for k in range(5) for t in texts)), "doc_id long, text string"), most_regions=1).collect()
    assert again and sum(again) < 3 * few  # five times the occurrences; other regions only where the ends differ


def test_repeats_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip((d["doc_id"] for d in docs), without_repeats([d["text"] for d in docs], 400), strict=True))
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_suffix_dedup"](spark, sf).collect()} == want


def test_intervals():
    rng = np.random.default_rng(0)
    for _ in range(60):
        least = int(rng.integers(3, 9))
        base = bytes(rng.integers(97, 100, 60).astype(np.uint8))
        regions = []
        for _ in range(int(rng.integers(1, 7))):
            a = int(rng.integers(0, 40))
            x = bytearray(base[a : a + least + int(rng.integers(0, 20))].ljust(least, b"q"))
            x[int(rng.integers(0, len(x)))] = int(rng.integers(97, 100))
            regions.append(bytes(x))
        copies = rng.integers(1, 3, len(regions))
        seen = Counter()
        for g, c in zip(regions, copies, strict=True):
            for k in range(len(g) - least + 1):
                seen[g[k : k + least]] += c
        want = [k + least <= len(g) and seen[g[k : k + least]] > 1 for g in regions for k in range(len(g) + 1)]
        assert suffix.repeated_starts(regions, copies, least).tolist() == want


def test_components(spark):
    r = random.Random(2)
    for edges in ([], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(50)], [(r.randint(-30, 30), r.randint(-30, 30)) for _ in range(35)]):
        near: dict[int, set] = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want, left = {}, set(near)
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                x = todo.pop()
                group.add(x)
                todo += near[x] - group
            left -= group
            want |= dict.fromkeys(group, min(group))
        df = spark.createDataFrame(edges, "a long, b long")
        assert {x["node"]: x["component"] for x in components(df).collect()} == want
