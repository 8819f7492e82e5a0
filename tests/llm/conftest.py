import pytest

#: Texts that are odd in one way or another: null, empty, blank, ties, copies, very long.
TEXTS = [None, "", "  \t\n ", "one", "same words in here again", "same words in here again", "é ß 漢字 ＡＢ\u00a0x", "a" * 5000, " ".join(f"w{i % 977}" for i in range(60_000)), "A-Z and\x1cthings ... <|endoftext|> <b>&amp;</b>"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents: null ids and sources, repeated rows, and columns whose names clash with inner ones."""
    rows = [(k, t, None if k % 4 == 3 else "en", None if k % 3 == 2 else f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s0", 5), (None, None, None, None, None), (4, TEXTS[4], "en", "s1", 24), (4, TEXTS[4], "en", "s1", 24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: __import__("pyspark").sql.functions.lit(1) for c in ("row", "key", "print", "score", "copies", "size", "nth", "mix_key", "simhash_key", "winnow_key", "toxic_score", "id", "length", "component", "k1", "anchor", "toxic_text")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
